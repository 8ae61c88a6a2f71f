"""First principal component of a trailing delay embedding.

No state runs from bar to bar, so even one instrument is dealt out in blocks of
bars, each with the bars before it that its windows need."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2000


def _project(x: np.ndarray, window: int, lags: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if len(x) < window + lags - 1:
        return out
    embedded = np.lib.stride_tricks.sliding_window_view(x, lags)[:, ::-1]
    for i, block in enumerate(np.lib.stride_tricks.sliding_window_view(embedded, window, axis=0)):
        rows = block.T
        if np.isfinite(rows).all():
            centred = rows - rows.mean(axis=0)
            loading = np.linalg.svd(centred, full_matrices=False)[2][0]
            out[i + window + lags - 2] = centred[-1] @ loading * np.sign(loading[np.abs(loading).argmax()])
    return out


def rolling_pca(frame: DataFrame, x: str, window: int = 60, lags: int = 3, out: str = "value", keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """The newest bar on the window's first component, its largest loading positive; null where a value is missing."""
    halo = window + lags - 2
    blocks = F.array_distinct(F.array(F.floor(F.col("bar_ix") / BLOCK), *[F.floor((F.col("bar_ix") + k) / BLOCK) for k in {min(halo, BLOCK), halo}]))
    dealt = frame.withColumn("__block", F.explode(blocks))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_ix")
        pdf[out] = _project(pdf[x].to_numpy(dtype=float), window, lags)
        return pdf[pdf["bar_ix"] // BLOCK == pdf["__block"]].drop(columns="__block")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name != out)
    done = dealt.groupBy(*keys, "__block").applyInPandas(run, f"{fields}, `{out}` double")
    return done.withColumn(out, F.nanvl(out, F.lit(None).cast("double")))
