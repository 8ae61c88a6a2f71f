"""Risk sizing of a running position, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.windows import KEYS


def entries(position: Column, keys=KEYS) -> Column:
    """1 where the sign changes into a side."""
    now = F.coalesce(F.signum(position), F.lit(0.0))
    return ((now != 0) & (now != F.coalesce(F.lag(now).over(w.by_bar(keys)), F.lit(0.0)))).cast("double")


def vol_target(position: Column, returns: Column, window: int = 60, target: float = 0.15, max_leverage: float = 3.0, keys=KEYS) -> Column:
    realised = w.rolling_std(returns, window, keys)
    return position * F.greatest(F.lit(0.0), F.when(realised > 0, F.least(F.lit(max_leverage), target / realised)))


def kelly(position: Column, returns: Column, window: int = 120, fraction: float = 0.25, cap: float = 1.0, keys=KEYS) -> Column:
    mean, std = w.rolling_mean(returns, window, keys), w.rolling_std(returns, window, keys)
    return position * F.abs(F.when(std > 0, F.greatest(F.lit(-cap), F.least(F.lit(cap), fraction * mean / (std * std)))))


def time_stop(frame: DataFrame, position: str = "position", out: str = "stopped", max_bars: int = 20, keys=KEYS) -> DataFrame:
    """Flat for one bar after each ``max_bars`` bars on one side; the count starts anew after it."""
    side = F.coalesce(F.signum(F.col(position)), F.lit(0.0))
    bars = w.by_bar(keys)
    marked = frame.withColumn("__side", side).withColumn("__new", (F.col("__side") != F.coalesce(F.lag("__side").over(bars), F.lit(0.0))).cast("int"))
    marked = marked.withColumn("__island", F.sum("__new").over(bars))
    k = F.row_number().over(Window.partitionBy(*keys, "__island").orderBy("bar_ix"))
    return marked.withColumn(out, F.when((F.col("__side") != 0) & (k % (max_bars + 1) == 0), 0.0).otherwise(F.col(position))).drop("__side", "__new", "__island")
