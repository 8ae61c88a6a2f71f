"""Trailing windows under a function of one's own."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From windows, one a row, to a number for each.
Reducer = Callable[[np.ndarray], np.ndarray]


def rolling_apply(frame: DataFrame, x: str, n: int, reducer: Reducer, out: str = "value", keys: tuple[str, ...] = ("instrument",), block: int = 5_000, skip_nulls: bool = False) -> DataFrame:
    """``frame`` with ``out``: ``reducer`` of each full window of ``n`` bars that
    holds no null (with ``skip_nulls`` it gets them as NaN).

    ``reducer`` takes an (m, n) array of windows, oldest bar first, and gives m
    numbers. A series is dealt out in blocks of bars, each with the n - 1 bars
    before it, so one instrument makes as many tasks as it has blocks. Bars are
    numbered from 0 without gaps (``bar_ix``). No window sees a later bar."""
    if n < 1 or block < 1:
        raise ValueError("a window and a block hold a bar at least")
    number = F.floor(F.col("bar_ix") / block)
    last = F.floor((F.col("bar_ix") + n - 1) / block)  # the last block whose windows reach back to this bar
    dealt = frame.withColumn("__block", F.explode(F.sequence(number, last)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_ix")
        values = pdf[x].to_numpy(dtype=float)
        made = np.full(len(values), np.nan)
        if len(values) >= n:
            windows = np.lib.stride_tricks.sliding_window_view(values, n)
            known = np.ones(len(windows), bool) if skip_nulls else ~np.isnan(windows).any(axis=1)
            if known.any():
                found = np.asarray(reducer(windows[known]), dtype=float)
                if found.shape != (int(known.sum()),):
                    raise ValueError(f"the reducer gave {found.shape} for {int(known.sum())} windows")
                made[n - 1 :][known] = found
        pdf = pdf.drop(columns=[c for c in (out,) if c in pdf.columns]).assign(**{out: pd.Series(made, index=pdf.index)})
        own = pdf["bar_ix"] // block == pdf["__block"]
        return pdf[own].drop(columns="__block")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name != out)
    made = dealt.groupBy(*keys, "__block").applyInPandas(run, f"{fields}, `{out}` double")
    return made.withColumn(out, F.nanvl(out, F.lit(None).cast("double")))
