"""Quality classifier (operator 9): sizes under two zstandard dictionaries."""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise

#: Bounds of what the driver fits on: rows of each label, and bytes that each dictionary is trained on.
SAMPLE_ROWS = 3000
DICTIONARY_TEXTS = 32 << 20
DICTIONARY_BYTES = 112 << 10
LEVEL = 1
BLOCK = 256


@dataclasses.dataclass(frozen=True)
class Classifier:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    level: int = LEVEL

    def difference(self, compressors, text: bytes) -> float:
        """(bad - good) / (bad + good) of the compressed sizes: over 0 where the
        good dictionary fits better. Texts are compressed block by block,
        whole, so that a dictionary counts at their end as at their start."""
        if not text:
            return 0.0
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        g, b = (sum(len(c.compress(x)) for x in blocks) for c in compressors)
        return (b - g) / (b + g)

    def compressors(self) -> tuple:
        out = []
        for content in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_dict_id=False))
        return tuple(out)

    def calibrated(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.offset, -500, 500)))


def spread(text: bytes, share: float) -> bytes:
    """Blocks of a text that are evenly spaced over it, ``share`` of them and one at least; the whole text from 1 on."""
    if share >= 1:
        return text
    n = -(-len(text) // BLOCK)
    k = max(1, int(n * share)) if n else 0
    return b"".join(text[(2 * i + 1) * n // (2 * k) * BLOCK :][:BLOCK] for i in range(k))


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts themselves where they are too few to
    train one: whole, or evenly spaced blocks of all of them if they are longer."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        joined = b"\n".join(texts)
        return spread(joined, (DICTIONARY_BYTES - BLOCK) / max(1, len(joined))) if len(joined) > DICTIONARY_BYTES else joined


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method on standardised x, with a small ridge so that separable data have an answer."""
    centre = np.average(x, weights=weight)
    scale = np.sqrt(np.average((x - centre) ** 2, weights=weight)) or 1.0
    design = np.stack([(x - centre) / scale, np.ones_like(x)], axis=1)
    w, ridge = np.zeros(2), np.diag([1e-3 * weight.sum(), 1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge, design.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * centre / scale)


def learnable(id_col: str = "doc_id") -> "Column":
    """Rows to learn from: crc32 of the id as text is no multiple of 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", dictionary_texts: int = DICTIONARY_TEXTS) -> Classifier:
    """Fit on at most ``rows`` labelled rows of each class, those with the
    smallest keyed hash.

    Every other sampled row goes into its label's dictionary with its whole
    text. Where these texts come to more than ``dictionary_texts`` bytes, every
    one of them, long or short, gives the same share of its blocks, evenly
    spaced over it. The rest calibrates the score by their whole texts, so that
    the score isn't fitted on texts that the dictionaries hold.
    A calibrating row counts for as many labels of its class as it was drawn
    from, so that the balance of classes is that of all learnable labels.

    Null labels, ids or texts don't take part; of rows that repeat a labelled
    id the smallest text does. A class that has no rows leaves an empty
    dictionary; with no rows at all every score is one half. Other columns are
    ignored.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label")).filter(learnable("__id") & F.col("label").isin(0, 1)).distinct()
    weight = {r["label"]: max(1.0, r["count"] / rows) for r in known.groupBy("label").count().collect()}
    chosen = None
    for label in (0, 1):
        few = known.filter(F.col("label") == label).orderBy(F.xxhash64("__id"), "__id").limit(rows)
        chosen = few if chosen is None else chosen.union(few)
    # At most 2 * rows ids: a table of bounded size.
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id").filter("text IS NOT NULL AND text <> ''")
    sample = materialise(sample.groupBy("__id", "label").agg(F.min("text").alias("text")))

    def in_order(frame: DataFrame) -> dict[int, list]:
        """Rows by label, in an order that is the same for all collections."""
        data = sorted((zlib.crc32(str(r[0]).encode()), *r) for r in frame.collect())
        return {label: [r[1:] for r in data if r[2] == label] for label in (0, 1)}

    taken = in_order(sample.select("__id", "label", F.octet_length("text")))
    ids = [(i, label, min(1.0, dictionary_texts / max(1, sum(r[2] for r in own[::2])))) for own in taken.values() for i, label, _ in own[::2]]
    picked = docs.sparkSession.createDataFrame(ids, f"__id {sample.schema['__id'].dataType.simpleString()}, label int, share double")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [spread(t.as_buffer().to_pybytes(), share) for t, share in zip(batch.column(3), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.binary())], ["__id", "label", "text"])

    chosen_texts = sample.join(F.broadcast(picked), ["__id", "label"]).select("__id", "label", "share", "text")
    sets = in_order(chosen_texts.mapInArrow(blocks, f"__id {sample.schema['__id'].dataType.simpleString()}, label int, text binary"))
    good, bad = (_dictionary([bytes(r[2]) for r in sets[label]]) for label in (1, 0))
    model = Classifier(good, bad, 0.0, 0.0)
    handle = docs.sparkSession.sparkContext.broadcast(model)

    id_type = sample.schema["__id"].dataType.simpleString()

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = handle.value.compressors()
        for batch in batches:
            d = pa.array([handle.value.difference(compressors, t.as_buffer().to_pybytes()) for t in batch.column(2)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], d], ["__id", "label", "difference"])

    found = in_order(sample.mapInArrow(differences, f"__id {id_type}, label int, difference double"))
    held = [(d, label, weight[label]) for own in found.values() for _, label, d in own[1::2]]
    if not held:
        return model
    x, y, w = (np.array(c, float) for c in zip(*held))
    slope, offset = _logistic(x, y, w)
    return dataclasses.replace(model, slope=slope, offset=offset)


def score(docs: DataFrame, model: Classifier, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text, in one scan
    without a shuffle. The score reads the text alone.

    Null and empty texts have the score of no difference. Null ids are not
    held out; repeated rows stay as they are; an empty table gives an empty
    result; other columns are ignored.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most 112 KiB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = handle.value
        compressors = m.compressors()
        for batch in batches:
            d = np.array([m.difference(compressors, t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(2)])
            s = m.calibrated(d)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(~learnable(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(lean(run), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Classifier, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or
    more, in one scan. Null and empty texts have the score of no difference;
    ids aren't read, so null and repeated ones stay as they are; an empty table
    stays empty."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = handle.value
        compressors = m.compressors()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            d = np.array([m.difference(compressors, t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts])
            yield batch.filter(pa.array(m.calibrated(d) >= threshold, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
