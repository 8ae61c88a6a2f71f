"""Embedding whitening (operator 11) by block Jacobi-Davidson, matrix-free."""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

COMPONENTS = 32
#: A residual is at double precision within so many units of rounding of the largest eigenvalue.
ROUNDINGS = 512
#: Eigenvalues under this share of the largest count as zero: such a component can't be whitened.
RANK = 1e-10
#: Matrix entries that one round of partial sums may bring to the driver; beyond, they are summed in groups first.
TO_DRIVER = 8_000_000


@dataclass
class Components:
    n: int
    sums: list[int]
    vectors: np.ndarray  # dimensions x components
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int
    tasks: int


# -- sums over the table ---------------------------------------------------


def _packed(value: np.ndarray) -> bytes:
    to = io.BytesIO()
    np.save(to, value, allow_pickle=value.dtype == object)
    return to.getvalue()


def _unpacked(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=True)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's ``x`` as rows."""
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def summed(rows: DataFrame, tasks: int, of: Callable[[np.ndarray], np.ndarray], entries: int) -> np.ndarray:
    """The sum over all rows of ``of(x)``, an array of ``entries`` entries, added
    up in ``tasks`` tasks. Up to ``TO_DRIVER`` entries in all come to the driver,
    in the order of tasks; from more tasks than that they are summed in groups first."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if len(batch):
                more = of(_vectors(batch))
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_packed(total)], pa.binary())], names=["part", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = None, None
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first = part if first is None else first
                total = _unpacked(data) if total is None else total + _unpacked(data)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([_packed(total)], pa.binary())], names=["part", "sums"])

    parts = rows.select("x").mapInArrow(part, "part bigint, sums binary")
    most = max(1, TO_DRIVER // max(entries, 1))
    if tasks > most:
        parts = parts.repartition(most, "part").sortWithinPartitions("part").mapInArrow(merge, "part bigint, sums binary")
    found = sorted((r["part"], bytes(r["sums"])) for r in parts.collect())
    return sum((_unpacked(data) for _, data in found[1:]), _unpacked(found[0][1]))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: the whole part is subtracted as whole numbers, so nothing cancels."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


# -- Jacobi-Davidson ---------------------------------------------------------

Product = Callable[[np.ndarray], np.ndarray]


def minres(apply: Product, b: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """x with A x = b for each column of ``b``, A symmetric, which may be
    indefinite and singular: at most ``steps`` Lanczos steps from 0, until every
    column's residual is under ``tolerance`` of its start. Columns go their own
    way but share each product."""
    x = np.zeros_like(b)
    v_old, w, w_old = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    gamma = np.linalg.norm(b, axis=0)
    start = np.where(gamma > 0, gamma, 1.0)
    v, eta = b / start, gamma.copy()
    gamma = np.zeros_like(gamma)
    s = s_old = np.zeros_like(gamma)
    c = c_old = np.ones_like(gamma)
    for _ in range(steps):
        live = np.abs(eta) > tolerance * start
        if not live.any():
            break
        av = apply(v)
        delta = (av * v).sum(0)
        nxt = av - v * delta - v_old * gamma
        gamma_next = np.linalg.norm(nxt, axis=0)
        a0 = c * delta - c_old * s * gamma
        a1 = np.hypot(a0, gamma_next)
        a2 = s * delta + c_old * c * gamma
        a3 = s_old * gamma
        live &= a1 > 0
        a1 = np.where(a1 > 0, a1, 1.0)
        c_old, s_old, c, s = c, s, a0 / a1, gamma_next / a1
        w_old, w = w, (v - w_old * a3 - w * a2) / a1
        x += np.where(live, c * eta, 0.0) * w
        eta = np.where(live, -s * eta, 0.0)
        v_old, v, gamma = v, nxt / np.where(gamma_next > 0, gamma_next, 1.0), gamma_next
    return x


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The directions of ``new`` that ``against`` hasn't, orthonormal."""
    for _ in range(2):
        for a in against:
            new = new - a @ (a.T @ new)
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-8 * max(1.0, s[0] if len(s) else 0.0)] if new.shape[1] else new
    return new


def jacobi_davidson(product: Product, d: int, wanted: int, seed: int = 0, steps: int = 12, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenpairs of a symmetric d x d operator that is
    known by its products with blocks of columns: vectors, values, residuals.

    The search space starts with random columns. Each round takes its Ritz
    pairs; leading pairs whose residual is at double precision are locked and
    leave the space; for the other wanted ones the correction equation
    (I - QQ')(V - e)(I - QQ') t = -r, Q the locked and current vectors, is
    solved by ``steps`` of MINRES at most, and t joins the space, which restarts
    from its best Ritz vectors when it has three times the wanted columns. At
    the end the locked pairs' residuals are measured by a fresh product; if
    one isn't at double precision, all are the start of a new search.
    """
    random = np.random.default_rng(seed)
    most = min(d, 3 * wanted + 8)
    start = _orthonormal(random.standard_normal((d, min(d, wanted + 8))))
    locked, values = np.zeros((d, 0)), np.zeros(0)
    space, image = start, product(start)
    scale = 0.0
    for _ in range(rounds):
        h = space.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, image_ritz = space @ y, image @ y
        scale = max(scale, theta[0] if len(theta) else 0.0, values[0] if len(values) else 0.0)
        floor = ROUNDINGS * np.finfo(float).eps * scale
        residual = image_ritz - ritz * theta
        residual -= locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        need = wanted - locked.shape[1]
        good = 0
        while good < min(need, len(theta)) and norms[good] <= floor:
            good += 1
        locked = np.hstack([locked, ritz[:, :good]])
        values = np.concatenate([values, theta[:good]])
        if locked.shape[1] == wanted:
            order = np.argsort(-values)
            locked = np.linalg.qr(locked[:, order])[0]
            image = product(locked)
            h = locked.T @ image
            theta, y = np.linalg.eigh((h + h.T) / 2)
            theta, y = theta[::-1], y[:, ::-1]
            vectors, image = locked @ y, image @ y
            norms = np.linalg.norm(image - vectors * theta, axis=0)
            if (norms <= floor).all():
                return vectors, theta, norms
            extra = _orthonormal(random.standard_normal((d, 8)), vectors)
            space, image = np.hstack([vectors, extra]), np.hstack([image, product(extra)])
            locked, values = np.zeros((d, 0)), np.zeros(0)
            continue
        ritz, image_ritz, theta, residual, norms = ritz[:, good:], image_ritz[:, good:], theta[good:], residual[:, good:], norms[good:]
        need -= good
        if space.shape[1] - good + need > most and space.shape[1] + locked.shape[1] - good < d:  # restart
            keep = min(ritz.shape[1], need + 8)
            space, image = ritz[:, :keep], image_ritz[:, :keep]
        else:
            space, image = ritz, image_ritz
        at = np.flatnonzero(norms[:need] > floor)
        q = np.hstack([locked, ritz[:, :need]])
        outside = lambda x, q=q: x - q @ (q.T @ x)

        def correction(t: np.ndarray, shift: np.ndarray = theta[at], outside=outside) -> np.ndarray:
            t = outside(t)
            return outside(product(t) - t * shift)

        new = minres(correction, outside(-residual[:, at]), steps, 0.05) if len(at) and q.shape[1] < d else np.zeros((d, 0))
        lengths = np.linalg.norm(new, axis=0)
        new = _orthonormal(new[:, lengths > 0] / lengths[lengths > 0], locked, space)
        if not new.shape[1] and space.shape[1] + locked.shape[1] < d:  # nothing new: search elsewhere
            new = _orthonormal(random.standard_normal((d, min(8, d - space.shape[1] - locked.shape[1]))), locked, space)
        if new.shape[1]:
            space, image = np.hstack([space, new]), np.hstack([image, product(new)])
            # Images are measured again with the space, so their rounding doesn't pile up over restarts.
        else:
            space = _orthonormal(space, locked)
            image = product(space)
    raise ArithmeticError(f"not at double precision after {rounds} rounds")


# -- whitening ---------------------------------------------------------------


def fit_list(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``vec_id, x`` of the rows that remain, x = floor(scale * c) + shift; see ``whitened``."""
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c")).filter("c IS NOT NULL AND forall(c, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity'))")
    rows = materialise(rows.select("vec_id", F.transform("c", lambda v: (F.floor(v * scale) + shift).cast("long")).alias("x")))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    common = sizes.agg(F.max_by("d", F.struct("n", "d"))).first()[0]
    return rows.filter(F.size("x") == F.lit(common)) if common is not None else rows


def components(rows: DataFrame, most: int = COMPONENTS) -> Components | None:
    """Mean sums and leading components of ``rows`` (vec_id, x); None without rows or variance."""
    n, d, tasks = rows.withColumn("task", F.spark_partition_id()).agg(F.count("*"), F.max(F.size("x")), F.max("task") + 1).first()
    if not n or not d:
        return None
    sums = [int(v) for v in summed(rows, tasks, lambda x: x.sum(0, dtype=object), d)]
    trace = float(summed(rows, tasks, lambda x: np.array([(centred(x, n, sums) ** 2).sum()]), 1)[0]) / n
    if trace == 0:
        return None
    passes = 0

    def product(u: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def of(x: np.ndarray) -> np.ndarray:
            y = centred(x, n, sums)
            return y.T @ (y @ u)

        return summed(rows, tasks, of, d * u.shape[1]) / n

    vectors, values, residuals = jacobi_davidson(product, d, min(most, d))
    keep = values > RANK * values[0]
    return Components(n, sums, vectors[:, keep], values[keep], trace, residuals[keep], passes, tasks)


def _covariance_error(rows: DataFrame, tasks: int, whiten: Callable[[np.ndarray], np.ndarray], k: int, n: int) -> float:
    """The largest absolute entry of the whitened rows' covariance (centred first, divisor n) minus the identity."""
    mean = summed(rows, tasks, lambda x: whiten(x).sum(0), k) / n

    def of(x: np.ndarray) -> np.ndarray:
        w = whiten(x) - mean
        return w.T @ w

    return float(np.abs(summed(rows, tasks, of, k * k) / n - np.eye(k)).max())


def whitened(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """``vec_id, n, deviation decimal(38,0), whitened array<double>, explained
    array<double>, identity_error``: each vector's whitened coordinates in the
    ``most`` leading components, largest variance first.

    Rows whose vector is null or holds a null or non-finite entry are dropped.
    The others become whole numbers (``fit_list``); ``deviation`` is exact. A
    component is at double precision (``jacobi_davidson``); of components with
    equal variance any orthonormal choice may come. A component without variance
    (under 1e-10 of the largest) can't be whitened and is left out, so a table
    of one vector, or of equal ones, gives no row, as does an empty one. Of
    vectors of several lengths those of the commonest length remain (of equally
    common ones the longest). Repeated rows and null ids are rows like others;
    other columns are ignored, whatever their names.
    """
    rows = fit_list(embeddings, id_col, vector_col)
    schema = "vec_id bigint, n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    found = components(rows, most)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    n, sums, k = found.n, found.sums, len(found.values)
    scaled = found.vectors / np.sqrt(found.values)
    whiten = lambda x: centred(x, n, sums) @ scaled
    error = _covariance_error(rows, found.tasks, whiten, k, n)
    explained = found.values / found.trace
    whole, rest = [s // n for s in sums], [s % n for s in sums]
    squares = sum(r * r for r in rest)

    def deviations(x: np.ndarray) -> list[Decimal]:
        # n*x - S = n*y - rest, so the sum of squares is n*n*sum(y*y) - 2*n*sum(y*rest) + sum(rest*rest)
        y = x - np.array(whole, dtype=np.int64)
        small = max(1, int(np.abs(y).max(initial=0))) ** 2 * y.shape[1] < 2**62 and max(1, int(np.abs(y).max(initial=0))) * max(rest) * y.shape[1] < 2**62
        y = y if small else y.astype(object)
        a, b = (y * y).sum(1), (y * np.array(rest, dtype=np.int64 if small else object)).sum(1)
        return [Decimal(n * n * int(p) - 2 * n * int(q) + squares) for p, q in zip(a, b, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = len(batch)
            if m:
                x = _vectors(batch)
                w = pa.array(whiten(x).reshape(-1), pa.float64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * k, pa.int32()), w)
                ratio = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * k, pa.int32()), pa.array(np.tile(explained, m)))
                columns = [batch.column("vec_id"), pa.array([n] * m, pa.int64()), pa.array(deviations(x), pa.decimal128(38, 0)), lists, ratio, pa.array([error] * m, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, schema)


def by_component(result: DataFrame) -> DataFrame:
    """One row per vector and component, numbered from 1."""
    each: Column = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    rows = result.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", each)
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
