"""Transforms of one series: all causal, null in the warm-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.windows import KEYS


def zscore(x: Column, window: int = 20, keys=KEYS) -> Column:
    std = w.rolling_std(x, window, keys)
    return F.when(std == 0, 0.0).otherwise((x - w.rolling_mean(x, window, keys)) / std)


def percent_rank(x: Column, window: int = 20, keys=KEYS) -> Column:
    """The share of the window that isn't above the current value; a null counts as above."""
    full = F.row_number().over(w.by_bar(keys)) >= window
    values = F.collect_list(x).over(w.trailing(window, keys))
    return F.when(full & x.isNotNull(), F.size(F.filter(values, lambda v: v <= x)) / window)


def roc(x: Column, period: int = 10, keys=KEYS) -> Column:
    past = w.shift(x, period, keys)
    return F.when(past != 0, x / past - 1)


def log_return(x: Column, period: int = 1, keys=KEYS) -> Column:
    past = w.shift(x, period, keys)
    return F.when((x > 0) & (past > 0), F.log(x / past))


def frac_diff_weights(d: float = 0.4, threshold: float = 1e-4, max_width: int = 200) -> list[float]:
    """Binomial weights of (1 - L)^d, up to the first that is smaller than the threshold."""
    out = [1.0]
    while len(out) < max_width:
        nxt = out[-1] * (len(out) - 1 - d) / len(out)
        if abs(nxt) < threshold:
            break
        out.append(nxt)
    return out


def frac_diff(x: Column, d: float = 0.4, threshold: float = 1e-4, max_width: int = 200, keys=KEYS) -> Column:
    weights = frac_diff_weights(d, threshold, max_width)
    newest_last = F.array(*[F.lit(v) for v in reversed(weights)])
    terms = F.zip_with(w.rolling_list(x, len(weights), keys), newest_last, lambda a, b: a * b)
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def wavelet_detail(x: Column, window: int = 64, level: int = 2, keys=KEYS) -> Column:
    """Newest detail of repeated two-tap smoothing: the mean of 2^(level-1) bars less that of 2^level."""
    if 2**level > window:
        return F.lit(None).cast("double")
    full = F.count(x).over(w.trailing(window, keys)) == window
    return F.when(full, w.rolling_mean(x, 2 ** (level - 1), keys) - w.rolling_mean(x, 2**level, keys))
