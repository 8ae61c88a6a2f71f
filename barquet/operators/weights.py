"""Weights across the instruments of one date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w


def of_date(keys: tuple[str, ...] = ()):
    return Window.partitionBy(*keys, "date")


def equal_weight(returns: Column, keys=()) -> Column:
    n = F.count(returns).over(of_date(keys))
    return F.when((n > 0) & returns.isNotNull(), 1.0 / n).when(n > 0, 0.0)


def normalise(weight: Column, keys=()) -> Column:
    total = F.sum(F.abs(weight)).over(of_date(keys))
    return F.when(total > 0, weight / total)


def risk_parity(frame: DataFrame, returns: str, window: int = 60, out: str = "weight", keys: tuple[str, ...] = ()) -> DataFrame:
    """Weights inverse to the trailing deviation of what returns there are; from the first full window on."""
    own = (*keys, "instrument")
    std = F.stddev_samp(returns).over(w.trailing(window, own))
    inverse = frame.withColumn("__inverse", F.when(std > 0, 1 / std).otherwise(0.0))
    total = F.sum("__inverse").over(of_date(keys))
    return inverse.withColumn(out, F.when((F.col("bar_ix") >= window - 1) & (total > 0), F.col("__inverse") / total)).drop("__inverse")
