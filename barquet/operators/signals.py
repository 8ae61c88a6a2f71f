"""Signals: -1, 0, 1 by direction, or 0 and 1; null in gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.windows import KEYS
from .transforms import roc, zscore


def _direction(up: Column, down: Column, *inputs: Column) -> Column:
    known = inputs[0].isNotNull()
    for x in inputs[1:]:
        known = known & x.isNotNull()
    return F.when(known, F.when(up, 1.0).when(down, -1.0).otherwise(0.0))


def _flag(on: Column, *inputs: Column) -> Column:
    return _direction(on, F.lit(False), *inputs)


def crossover(fast: Column, slow: Column, min_gap_pct: float = 0.0) -> Column:
    gap = F.when(slow != 0, (fast - slow) / slow)
    return _direction(gap > min_gap_pct, gap < -min_gap_pct, gap)


def threshold(x: Column, upper: float | Column = 1.0, lower: float | Column = -1.0, above_is_long: bool | Column = True) -> Column:
    if not isinstance(lower, Column) and not isinstance(upper, Column) and lower > upper:
        raise ValueError("lower is above upper")
    high, low = x > upper, x < lower
    if isinstance(above_is_long, Column):
        return F.when(above_is_long, _direction(high, low, x)).otherwise(_direction(low, high, x))
    return _direction(high, low, x) if above_is_long else _direction(low, high, x)


def breakout(high: Column, low: Column, close: Column, lookback: int = 20, keys=KEYS) -> Column:
    """The close against the extremes of the bars before it."""
    before = w.by_bar(keys).rowsBetween(-lookback, -1)
    top = F.when(F.count(high).over(before) == lookback, F.max(high).over(before))
    bottom = F.when(F.count(low).over(before) == lookback, F.min(low).over(before))
    return _direction(close > top, close < bottom, close, top, bottom)


def vol_expansion(atr: Column, lookback: int = 20, multiple: float = 1.0, keys=KEYS) -> Column:
    mean = w.rolling_mean(atr, lookback, keys)
    return _flag(atr > multiple * mean, atr, mean)


def momentum(x: Column, period: int = 20, min_return: float = 0.0, keys=KEYS) -> Column:
    change = roc(x, period, keys)
    return _direction(change > min_return, change < -min_return, change)


def mean_reversion(x: Column, window: int = 20, entry_z: float = 2.0, keys=KEYS) -> Column:
    z = zscore(x, window, keys)
    return _direction(z < -entry_z, z > entry_z, z)


def volume_confirmation(volume: Column, window: int = 20, multiple: float = 1.5, keys=KEYS) -> Column:
    mean = w.rolling_mean(volume, window, keys)
    return _flag(volume > multiple * mean, volume, mean)


def both(a: Column, b: Column) -> Column:
    """Both long or both short, else flat: a flag doesn't keep a short."""
    return _direction((a > 0) & (b > 0), (a < 0) & (b < 0), a, b)


def either(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.signum(a) + F.signum(b))) + a * 0 + b * 0


def negate(a: Column) -> Column:
    return _flag(a == 0, a)


def combine_entries(signals: list[Column]) -> Column:
    """Several roots agree on a sign, or the result is flat."""
    signs = [F.coalesce(F.signum(s), F.lit(0.0)) for s in signals]
    low, high = (F.least(*signs), F.greatest(*signs)) if len(signs) > 1 else (signs[0], signs[0])
    return F.when(low > 0, 1.0).when(high < 0, -1.0).otherwise(0.0)


def combine_filters(signals: list[Column]) -> Column:
    on = F.lit(True)
    for s in signals:
        on = on & (F.coalesce(s, F.lit(0.0)) > 0)
    return on.cast("double")


def combine_exits(signals: list[Column]) -> Column:
    """Any root that isn't zero fires; a single root also fires where it is null."""
    if len(signals) == 1:
        return (~F.coalesce(signals[0] == 0, F.lit(False))).cast("double")
    fires = F.lit(False)
    for s in signals:
        fires = fires | (F.coalesce(s, F.lit(0.0)) != 0)
    return fires.cast("double")


def apply_roles(entry: Column, exits: list[Column] = (), filters: list[Column] = ()) -> Column:
    position = F.coalesce(entry, F.lit(0.0))
    if exits:
        position = F.when(combine_exits(list(exits)) != 0, 0.0).otherwise(position)
    if filters:
        position = F.when(combine_filters(list(filters)) > 0, position).otherwise(0.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), position))
