"""The operators that a spec may name: ports, parameters with their ranges, and
how each is worked out from columns of bars.

An operator is a Column of its inputs, a step function (``state``) or a function
of frames. It may ask for inner operators by ``needs``; these are shared like
the nodes of specs. More operators and versions are added by ``register``.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w
from . import pca, risk, signals, state, transforms

Keys = tuple[str, ...]
Inputs = dict[str, Column]
Params = dict[str, float | int | bool | str]
#: name of an inner operator, its parameters, and its inputs by the outer one's ports
Need = tuple[str, Params, dict[str, str]]


@dataclasses.dataclass(frozen=True)
class Param:
    name: str
    kind: str  # int, float, bool or str
    default: float | int | bool | str
    low: float | None = None
    high: float | None = None


@dataclasses.dataclass(frozen=True)
class Operator:
    name: str
    ports: tuple[str, ...]
    params: tuple[Param, ...] = ()
    column: Callable[[Inputs, Params, Keys], Column] | None = None
    step: Callable[[Params], state.Step] | None = None  # over the inputs named by ``rows``
    rows: tuple[str, ...] = ()
    frame: Callable[[DataFrame, dict[str, str], str, Params, Keys], DataFrame] | None = None
    needs: Callable[[Params], dict[str, Need]] | None = None
    implicit: tuple[str, ...] = ()  # ports that are the running position unless connected
    commutative: bool = False
    ordered: tuple[str, str] | None = None  # parameters of which the first may not be above the second
    pointwise: bool = False  # the column reads its own bar alone, and takes parameters that are columns
    warmup: Callable[[Params], int] = lambda p: 0
    version: str = "1.0.0"


LIBRARY: dict[tuple[str, str], Operator] = {}


def _order(version: str) -> tuple:
    return tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in version.split("."))


def register(operator: Operator) -> Operator:
    """Add an operator; a (name, version) means one thing for good, so taking it again is an error."""
    key = (operator.name, operator.version)
    if key in LIBRARY:
        raise ValueError(f"{operator.name}@{operator.version} is there already: take another version")
    if (operator.column is not None) + (operator.step is not None) + (operator.frame is not None) != 1:
        raise ValueError(f"{operator.name}: a column, a step or a frame function")
    for p in operator.params:
        checked(p, p.default)
    LIBRARY[key] = operator
    return operator


def newest(name: str) -> str | None:
    return max((v for n, v in LIBRARY if n == name), key=_order, default=None)


def checked(param: Param, value):
    """The value in the parameter's kind, or ValueError."""
    kinds = {"int": (int,), "float": (int, float), "bool": (bool,), "str": (str,)}
    if not isinstance(value, kinds[param.kind]) or isinstance(value, bool) and param.kind != "bool":
        raise ValueError(f"{param.name} must be {param.kind}, not {value!r}")
    value = float(value) if param.kind == "float" else value
    if param.kind == "float" and not math.isfinite(value):
        raise ValueError(f"{param.name} must be finite")
    if param.low is not None and value < param.low or param.high is not None and value > param.high:
        raise ValueError(f"{param.name} must be from {param.low} to {param.high}, not {value!r}")
    return value


def bind(name: str, version: str | None = None, **given) -> tuple[Operator, Params]:
    """The operator (of the newest version if none is named) and all its parameters, checked."""
    operator = LIBRARY.get((name, version or newest(name) or ""))
    if operator is None:
        raise ValueError(f"no operator {name}@{version or 'newest'}")
    known = {p.name: p for p in operator.params}
    if unknown := sorted(set(given) - set(known)):
        raise ValueError(f"{name} has no parameter {', '.join(unknown)}")
    bound = {n: checked(p, given.get(n, p.default)) for n, p in known.items()}
    if operator.ordered and bound[operator.ordered[0]] > bound[operator.ordered[1]]:
        raise ValueError(f"{name}: {operator.ordered[0]} is above {operator.ordered[1]}")
    return operator, bound


def table(spark) -> DataFrame:
    """The library as a table, a row an operator and version."""
    top = {n: newest(n) for n, _ in LIBRARY}
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    rows = [(o.name, o.version, o.version == top[o.name], list(o.ports), list(o.implicit), o.commutative, list(o.ordered or ()), [(p.name, p.kind, text(p.default), p.low, p.high) for p in o.params]) for o in (LIBRARY[k] for k in sorted(LIBRARY))]
    param = "struct<name: string, kind: string, default: string, low: double, high: double>"
    schema = f"operator string, version string, newest boolean, ports array<string>, implicit array<string>, commutative boolean, ordered array<string>, declared array<{param}>"
    return spark.createDataFrame([(*r[:7], [(*p[:3], *(None if x is None else float(x) for x in p[3:])) for p in r[7]]) for r in rows], schema)


# Names, defaults and ranges of ports and parameters.
def _window(default: int = 20, low: int = 2, high: int = 2000, name: str = "window") -> Param:
    return Param(name, "int", default, low, high)


_HLC = ("high", "low", "close")
_PERIOD = _window(14, 2, 500, "period")
_ATR = lambda p: {"atr": ("atr", {"period": p["period"]}, {x: x for x in _HLC})}
_series = lambda f: lambda x, p, k: f(x["series"], p, k)

for _o in (
    # inner operators
    Operator("true_range", _HLC, column=lambda x, p, k: w.true_range(x["high"], x["low"], x["close"], k)),
    Operator("simple_return", ("close",), column=lambda x, p, k: w.simple_return(x["close"], k)),
    Operator("entered_at", ("position",), column=lambda x, p, k: F.when(_side(x["position"]) != F.coalesce(F.lag(_side(x["position"])).over(w.by_bar(k)), F.lit(0.0)), F.col("bar_ix"))),
    # transforms
    Operator("rolling_mean", ("series",), (_window(),), _series(lambda x, p, k: w.rolling_mean(x, p["window"], k)), warmup=lambda p: p["window"] - 1),
    Operator("rolling_std", ("series",), (_window(),), _series(lambda x, p, k: w.rolling_std(x, p["window"], k)), warmup=lambda p: p["window"] - 1),
    Operator("ema", ("series",), (_window(20, 2, 2000, "span"),), step=lambda p: state.ema(p["span"]), rows=("series",), warmup=lambda p: p["span"] - 1),
    Operator("jma", ("series",), (_window(14, 2, 500, "length"), Param("phase", "float", 0.0, -100.0, 100.0), Param("power", "float", 2.0, 0.5, 4.0)), step=lambda p: state.jma(p["length"], p["phase"], p["power"]), rows=("series",), warmup=lambda p: p["length"] - 1),
    Operator("kalman", ("series",), (Param("process_var", "float", 1e-4, 1e-12, 10.0), Param("observation_var", "float", 1e-2, 1e-12, 100.0)), step=lambda p: state.kalman(p["process_var"], p["observation_var"]), rows=("series",)),
    Operator("atr", _HLC, (_PERIOD,), needs=lambda p: {"tr": ("true_range", {}, {x: x for x in _HLC})}, step=lambda p: state.wilder(p["period"]), rows=("tr",), warmup=lambda p: p["period"]),
    Operator("atr_normalise", ("series", *_HLC), (_PERIOD,), lambda x, p, k: F.when(x["atr"] > 0, x["series"] / x["atr"]), needs=_ATR, pointwise=True, warmup=lambda p: p["period"]),
    Operator("zscore", ("series",), (_window(),), _series(lambda x, p, k: transforms.zscore(x, p["window"], k)), warmup=lambda p: p["window"] - 1),
    Operator("percent_rank", ("series",), (_window(),), _series(lambda x, p, k: transforms.percent_rank(x, p["window"], k)), warmup=lambda p: p["window"] - 1),
    Operator("roc", ("series",), (_window(10, 1, 2000, "period"),), _series(lambda x, p, k: transforms.roc(x, p["period"], k)), warmup=lambda p: p["period"]),
    Operator("log_return", ("series",), (_window(1, 1, 2000, "period"),), _series(lambda x, p, k: transforms.log_return(x, p["period"], k)), warmup=lambda p: p["period"]),
    Operator("frac_diff", ("series",), (Param("d", "float", 0.4, 0.0, 1.0), Param("threshold", "float", 1e-4, 1e-8, 0.1), _window(200, 2, 5000, "max_width")), _series(lambda x, p, k: transforms.frac_diff(x, p["d"], p["threshold"], p["max_width"], k)), warmup=lambda p: len(transforms.frac_diff_weights(p["d"], p["threshold"], p["max_width"])) - 1),
    Operator("wavelet_detail", ("series",), (_window(64, 8), _window(2, 1, 6, "level")), _series(lambda x, p, k: transforms.wavelet_detail(x, p["window"], p["level"], k)), warmup=lambda p: p["window"] - 1),
    Operator("rolling_pca", ("series",), (_window(60, 10), _window(3, 2, 50, "lags")), frame=lambda f, x, out, p, k: pca.rolling_pca(f, x["series"], p["window"], p["lags"], out, k), warmup=lambda p: p["window"] + p["lags"] - 2),
    # signals
    Operator("crossover", ("fast", "slow"), (Param("min_gap_pct", "float", 0.0, 0.0, 1.0),), lambda x, p, k: signals.crossover(x["fast"], x["slow"], p["min_gap_pct"]), pointwise=True),
    Operator("threshold", ("series",), (Param("upper", "float", 1.0, -1e9, 1e9), Param("lower", "float", -1.0, -1e9, 1e9), Param("above_is_long", "bool", True)), _series(lambda x, p, k: signals.threshold(x, p["upper"], p["lower"], p["above_is_long"])), ordered=("lower", "upper"), pointwise=True),
    Operator("breakout", _HLC, (_window(name="lookback"),), lambda x, p, k: signals.breakout(x["high"], x["low"], x["close"], p["lookback"], k), warmup=lambda p: p["lookback"]),
    Operator("vol_expansion", _HLC, (_PERIOD, _window(name="lookback"), Param("multiple", "float", 1.0, 0.1, 10.0)), lambda x, p, k: signals.vol_expansion(x["atr"], p["lookback"], p["multiple"], k), needs=_ATR, warmup=lambda p: p["period"] + p["lookback"] - 1),
    Operator("momentum", ("series",), (_window(20, 1, 2000, "period"), Param("min_return", "float", 0.0, 0.0, 10.0)), _series(lambda x, p, k: signals.momentum(x, p["period"], p["min_return"], k)), warmup=lambda p: p["period"]),
    Operator("mean_reversion", ("series",), (_window(), Param("entry_z", "float", 2.0, 0.1, 10.0)), _series(lambda x, p, k: signals.mean_reversion(x, p["window"], p["entry_z"], k)), warmup=lambda p: p["window"] - 1),
    Operator("volume_confirmation", ("volume",), (_window(), Param("multiple", "float", 1.5, 0.1, 20.0)), lambda x, p, k: signals.volume_confirmation(x["volume"], p["window"], p["multiple"], k), warmup=lambda p: p["window"] - 1),
    Operator("and", ("a", "b"), (), lambda x, p, k: signals.both(x["a"], x["b"]), commutative=True, pointwise=True),
    Operator("or", ("a", "b"), (), lambda x, p, k: signals.either(x["a"], x["b"]), commutative=True, pointwise=True),
    Operator("not", ("a",), (), lambda x, p, k: signals.negate(x["a"]), pointwise=True),
    # risk
    Operator("atr_stop", ("position", "close", "high", "low"), (_PERIOD, Param("multiple", "float", 2.0, 0.1, 20.0)), step=lambda p: state.atr_stop(p["multiple"]), rows=("position", "close", "atr"), needs=_ATR, implicit=("position",), warmup=lambda p: p["period"]),
    Operator("trailing_stop", ("position", "close", "high", "low"), (_PERIOD, Param("multiple", "float", 3.0, 0.1, 20.0)), step=lambda p: state.trailing_stop(p["multiple"]), rows=("position", "close", "atr"), needs=_ATR, implicit=("position",), warmup=lambda p: p["period"]),
    Operator(
        "time_stop",
        ("position",),
        (Param("max_bars", "int", 20, 1, 10_000),),
        lambda x, p, k: F.when((_side(x["position"]) != 0) & ((F.col("bar_ix") - F.max(x["entered"]).over(w.by_bar(k)) + 1) % (p["max_bars"] + 1) == 0), 0.0).otherwise(x["position"]),
        needs=lambda p: {"entered": ("entered_at", {}, {"position": "position"})},
        implicit=("position",),
    ),
    Operator("vol_target", ("position", "returns"), (_window(60, 5), Param("target_vol", "float", 0.15, 1e-4, 10.0), Param("max_leverage", "float", 3.0, 0.1, 20.0)), lambda x, p, k: risk.vol_target(x["position"], x["returns"], p["window"], p["target_vol"], p["max_leverage"], k), implicit=("position",), warmup=lambda p: p["window"] - 1),
    Operator("kelly", ("position", "returns"), (_window(120, 10, 5000), Param("fraction", "float", 0.25, 0.01, 1.0), Param("cap", "float", 1.0, 0.01, 10.0)), lambda x, p, k: risk.kelly(x["position"], x["returns"], p["window"], p["fraction"], p["cap"], k), implicit=("position",), warmup=lambda p: p["window"] - 1),
):
    register(_o)


def _side(position: Column) -> Column:
    return F.coalesce(F.signum(position), F.lit(0.0))
