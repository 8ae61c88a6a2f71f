"""Recursions without a window form: one step function per operator, run over
the bars of each run and instrument, and reused by the streaming jobs.

A step takes the state and the row's values and returns (state, output). The
state is a tuple of floats and small lists, and no step looks ahead.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Step = Callable[[tuple, tuple], tuple[tuple, float | None]]


def _number(x) -> float | None:
    return None if x is None or x != x else float(x)


def ema(span: int = 20) -> Step:
    alpha = 2 / (span + 1)

    def step(state, row):
        seen, total, mean = state or (0, 0.0, None)
        x = row[0] if row[0] is not None else math.nan
        seen += 1
        if seen <= span:
            total += x
            mean = total / span if seen == span else None
        else:
            mean = alpha * x + (1 - alpha) * mean
        return (seen, total, mean), mean

    return step


def jma(length: int = 14, phase: float = 0.0, power: float = 2.0) -> Step:
    ratio = min(2.5, max(0.5, phase / 100 + 1.5))
    beta = 0.45 * (length - 1) / (0.45 * (length - 1) + 2)
    alpha = beta**power

    def step(state, row):
        seen, total, smooth, lag, speed, value = state or (0, 0.0, 0.0, 0.0, 0.0, None)
        x = row[0] if row[0] is not None else math.nan
        seen += 1
        if seen <= length:
            total += x
            if seen == length:
                smooth = lag = value = total / length
        else:
            smooth += (1 - alpha) * (x - smooth)
            lag = (1 - beta) * (x - smooth) + beta * lag
            speed = (smooth + ratio * lag - value) * (1 - alpha) ** 2 + alpha**2 * speed
            value += speed
        return (seen, total, smooth, lag, speed, value), value

    return step


def kalman(process_var: float = 1e-4, observation_var: float = 1e-2) -> Step:
    def step(state, row):
        x = row[0] if row[0] is not None else math.nan
        if state is None:
            return (x, 1.0), x
        level, cov = state
        cov += process_var
        gain = cov / (cov + observation_var)
        level += gain * (x - level)
        return (level, cov * (1 - gain)), level

    return step


def wilder(period: int = 14) -> Step:
    """Seeded with the mean of the first values that aren't null; a null holds the value."""

    def step(state, row):
        seen, total, mean = state or (0, 0.0, None)
        x = row[0]
        if x is not None:
            seen += 1
            if seen <= period:
                total += x
                mean = total / period if seen == period else None
            else:
                mean = (mean * (period - 1) + x) / period
        return (seen, total, mean), mean

    return step


def _side(x: float) -> float:
    return float((x > 0) - (x < 0))


def atr_stop(multiple: float = 2.0) -> Step:
    """Rows (position, close, atr). The stop is set at entry and stays; a stop flattens one bar."""

    def step(state, row):
        side, stop, before = state or (0.0, None, 0.0)
        position, close, atr = row
        out = position
        if not position:
            state = (0.0, None, 0.0)
        elif _side(position) != before or side == 0 or stop is None:
            side = _side(position)
            stop = close - side * multiple * atr if atr is not None and close is not None else None
            state = (side, stop, side)
        else:
            if close is not None and (close - stop) * side <= 0:
                out, side, stop = 0.0, 0.0, None
            state = (side, stop, _side(position))
        return state, out if atr is not None else None

    return step


def trailing_stop(multiple: float = 3.0) -> Step:
    """Rows (position, close, atr). The stop follows the best close since entry, and only tightens."""

    def step(state, row):
        side, best, stop = state or (0.0, None, None)
        position, close, atr = row
        out = position
        distance = multiple * atr if atr is not None else None
        if not position:
            state = (0.0, None, None)
        elif side == 0 or _side(position) != side:
            side = _side(position)
            state = (side, close, close - side * distance if distance is not None and close is not None else None)
        else:
            if close is not None:
                best = close if best is None else side * max(side * best, side * close)
            if distance is not None and best is not None:
                new = best - side * distance
                stop = new if stop is None else side * max(side * stop, side * new)
            if stop is not None and close is not None and (close - stop) * side <= 0:
                out, side, best, stop = 0.0, 0.0, None, None
            state = (side, best, stop)
        return state, out if atr is not None else None

    return step


def run_steps(frame: DataFrame, inputs: list[str], step: Step, out: str, keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """``frame`` with the step's outputs: one task per run and instrument at most, in bar order."""
    return run_many(frame, [(inputs, step, out)], keys)


def run_many(frame: DataFrame, jobs: list[tuple[list[str], Step, str]], keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """``frame`` with the outputs of several steps (inputs, step, output) that don't take in each other's, after one shuffle."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_ix")
        made = {}
        for inputs, step, out in jobs:
            state, values = None, []
            for row in zip(*(pdf[c].tolist() for c in inputs)):
                state, value = step(state, tuple(map(_number, row)))
                values.append(_number(value))
            made[out] = pd.Series(values, index=pdf.index, dtype="float64")
        return pdf.assign(**made)

    outs = [out for _, _, out in jobs]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name not in outs]
    return frame.groupBy(*keys).applyInPandas(run, ", ".join([*fields, *(f"`{out}` double" for out in outs)]))


@dataclasses.dataclass(frozen=True)
class Linear:
    """A step that is affine in a few numbers of its state once it is seeded:
    ``vector`` takes them out of a state, ``build`` makes a state of them and of
    how many rows came before, and ``seed`` rows come before it is so. With
    ``skips_nulls`` a row whose first input is null leaves the state as it is and
    isn't counted."""

    step: Step
    size: int
    seed: int
    vector: Callable[[tuple], tuple]
    build: Callable[[tuple, int], tuple]
    skips_nulls: bool = False


def linear_ema(span: int = 20) -> Linear:
    return Linear(ema(span), 1, span, lambda s: (s[2],), lambda v, n: (n, 0.0, v[0]))


def linear_jma(length: int = 14, phase: float = 0.0, power: float = 2.0) -> Linear:
    return Linear(jma(length, phase, power), 4, length, lambda s: s[2:], lambda v, n: (n, 0.0, *v))


def linear_kalman(process_var: float = 1e-4, observation_var: float = 1e-2) -> Linear:
    def build(v: tuple, n: int) -> tuple:
        # The variance depends on the number of rows alone, and settles after some.
        cov, before = 1.0, None
        for _ in range(n - 1):
            if cov == before:
                break
            before = cov
            cov = (cov + process_var) * (1 - (cov + process_var) / (cov + process_var + observation_var))
        return v[0], cov

    return Linear(kalman(process_var, observation_var), 1, 1, lambda s: (s[0],), build)


def linear_wilder(period: int = 14) -> Linear:
    """Affine from the first value on, in the sum of the seed and the mean: how many values came before says which of them moves."""
    return Linear(wilder(period), 2, 0, lambda s: (s[1] if s[0] < period else 0.0, s[2] or 0.0), lambda v, n: (n, v[0], None) if n < period else (n, 0.0, v[1]), skips_nulls=True)


def run_linear(frame: DataFrame, inputs: list[str], linear: Linear, out: str, keys: tuple[str, ...] = ("instrument",), block: int = 50_000) -> DataFrame:
    """What ``run_steps`` gives, for series too long for one task: blocks of bars
    each say how they move the state, these compose along the blocks of a series,
    and each block then runs from its own start. Series have a row a bar, counted
    from 0, and a block holds the seed."""
    if block < linear.seed:
        raise ValueError("a block must hold the seed")
    dealt = frame.withColumn("__block", F.floor(F.col("bar_ix") / block))
    if linear.skips_nulls:
        counts = dealt.groupBy(*keys, "__block").agg(F.count(F.nanvl(F.col(inputs[0]).cast("double"), F.lit(None).cast("double"))).alias("__here"))
        upto = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
        dealt = dealt.join(counts.select(*keys, "__block", F.coalesce(F.sum("__here").over(upto), F.lit(0)).alias("__before")), [*keys, "__block"])
    else:
        dealt = dealt.withColumn("__before", (F.col("__block") * block).cast("long"))
    names = {f.name: f.dataType.simpleString() for f in frame.schema}
    key_fields = ", ".join(f"`{k}` {names[k]}" for k in keys)

    def moved(rows: list[tuple], state: tuple | None) -> tuple[list[float | None], tuple | None]:
        values = []
        for row in rows:
            state, value = linear.step(state, row)
            values.append(_number(value))
        return values, state

    def rows_of(pdf: pd.DataFrame) -> list[tuple]:
        return [tuple(map(_number, row)) for row in zip(*(pdf[c].tolist() for c in inputs))]

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_ix")
        rows, first = rows_of(pdf), int(pdf["__before"].iloc[0])
        run = lambda start: [math.nan if x is None else x for x in linear.vector(moved(rows, start)[1])]
        if first == 0:
            shift, turn = run(None), [[0.0] * linear.size] * linear.size
        else:
            shift = run(linear.build((0.0,) * linear.size, first))
            turn = [[a - b for a, b in zip(run(linear.build(tuple(float(i == k) for i in range(linear.size)), first)), shift)] for k in range(linear.size)]
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "__block": pdf["__block"].iloc[0], "shift": shift, "turn": [x for row in turn for x in row]}])

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        at, out_rows = None, []
        for row in pdf.sort_values("__block").to_dict("records"):
            out_rows.append({**{k: row[k] for k in keys}, "__block": row["__block"], "start": at})
            shift, turn = list(row["shift"]), list(row["turn"])
            at = [shift[i] + (sum(at[k] * turn[k * linear.size + i] for k in range(linear.size)) if at else 0.0) for i in range(linear.size)]
        return pd.DataFrame(out_rows)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_ix")
        start, first = pdf["__start"].iloc[0], int(pdf["__before"].iloc[0])
        values, _ = moved(rows_of(pdf), linear.build(tuple(start), first) if start is not None else None)
        return pdf.drop(columns=["__block", "__before", "__start"]).assign(**{out: pd.Series(values, index=pdf.index, dtype="float64")})

    sums = dealt.select(*keys, "bar_ix", "__block", "__before", *[c for c in inputs if c not in (*keys, "bar_ix")]).groupBy(*keys, "__block").applyInPandas(summary, f"{key_fields}, __block long, shift array<double>, turn array<double>")
    begins = sums.groupBy(*keys).applyInPandas(starts, f"{key_fields}, __block long, start array<double>")
    fields = ", ".join(f"`{n}` {t}" for n, t in names.items() if n != out)
    return dealt.join(begins.withColumnRenamed("start", "__start"), [*keys, "__block"]).groupBy(*keys, "__block").applyInPandas(finish, f"{fields}, `{out}` double")
