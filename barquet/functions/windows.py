"""Trailing windows over the bars of one run and instrument.

A window that isn't full, or that holds a null, gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Columns that tell runs apart; more may be passed where several runs share a frame.
KEYS = ("instrument",)


def by_bar(keys: tuple[str, ...] = KEYS):
    return Window.partitionBy(*keys).orderBy("bar_ix")


def trailing(n: int, keys: tuple[str, ...] = KEYS):
    return by_bar(keys).rowsBetween(-(n - 1), 0)


def rolling(aggregate: Callable[[Column], Column], x: Column, n: int, keys: tuple[str, ...] = KEYS) -> Column:
    w = trailing(n, keys)
    return F.when(F.count(x).over(w) == n, aggregate(x).over(w))


def rolling_sum(x: Column, n: int, keys=KEYS) -> Column:
    return rolling(F.sum, x, n, keys)


def rolling_mean(x: Column, n: int, keys=KEYS) -> Column:
    return rolling(F.avg, x, n, keys)


def rolling_std(x: Column, n: int, keys=KEYS) -> Column:
    return rolling(F.stddev_samp, x, n, keys)


def rolling_max(x: Column, n: int, keys=KEYS) -> Column:
    return rolling(F.max, x, n, keys)


def rolling_min(x: Column, n: int, keys=KEYS) -> Column:
    return rolling(F.min, x, n, keys)


def rolling_list(x: Column, n: int, keys=KEYS) -> Column:
    """The window's values, oldest first: for reducers made of array functions."""
    return rolling(F.collect_list, x, n, keys)


def shift(x: Column, periods: int, keys=KEYS) -> Column:
    if periods < 0:
        raise ValueError("a negative shift would look ahead")
    return F.lag(x, periods).over(by_bar(keys)) if periods else x


def true_range(high: Column, low: Column, close: Column, keys=KEYS) -> Column:
    before = shift(close, 1, keys)
    return F.when(before.isNotNull() & high.isNotNull() & low.isNotNull(), F.greatest(high - low, F.abs(high - before), F.abs(low - before)))


def simple_return(close: Column, keys=KEYS) -> Column:
    before = shift(close, 1, keys)
    return F.when(before != 0, close / before - 1)
