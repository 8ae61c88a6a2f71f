"""Registered queries of the strategy-research operators, and their SQL.

Most run over weekly bars of the orders table: five instruments, one run. The
SQL states the same thing in DuckDB's words over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import windows as w
from .operators import risk, signals, state, transforms, weights
from .plans import backtest, metrics
from .sources import bars as source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PERIODS = 52


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def base(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """The panel with ``prev, ret, tr``."""
    p = source.panel(source.order_bars(spark, sf_dir, unit))
    p = p.withColumn("prev", w.shift(F.col("close"), 1))
    return p.withColumns({"ret": F.when(F.col("prev") != 0, F.col("close") / F.col("prev") - 1), "tr": w.true_range(F.col("high"), F.col("low"), F.col("close"))})


PANEL = """
raw AS (SELECT o_orderpriority AS instrument, CAST(date_trunc('week', o_orderdate) AS DATE) AS date, o_totalprice / 1000 AS price, o_orderkey AS k FROM orders),
bars AS (SELECT instrument, date, first(price ORDER BY k) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY k) AS close, CAST(count(*) AS DOUBLE) AS volume FROM raw GROUP BY instrument, date),
dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS bar_ix FROM (SELECT DISTINCT date FROM bars)),
panel AS (SELECT i.instrument, d.date, d.bar_ix, b.open, b.high, b.low, b.close, b.volume
          FROM dates d CROSS JOIN (SELECT DISTINCT instrument FROM bars) i LEFT JOIN bars b ON b.instrument = i.instrument AND b.date = d.date),
p0 AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY bar_ix) AS prev FROM panel),
p AS (SELECT *, CASE WHEN prev <> 0 THEN close / prev - 1 END AS ret,
             CASE WHEN prev IS NOT NULL AND high IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr FROM p0)"""
WITH = "WITH " + PANEL


def W(n: int) -> str:
    return f"OVER (PARTITION BY instrument ORDER BY bar_ix ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) {W(n)} = {n} THEN {agg}({x}) {W(n)} END)"


def lagged(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY instrument ORDER BY bar_ix)"


def value(name: str, column: Callable[[], Column], sql: str, before: str = "") -> None:
    """A query of (instrument, bar_ix, value), from one column over the panel."""
    add(name, lambda s, d: base(s, d).select("instrument", "bar_ix", column().alias("value")), f"{WITH}{before} SELECT instrument, bar_ix, {sql} AS value FROM p")




def c(name: str) -> Column:
    return F.col(name)


# Bars and panel
add("io18_panel", lambda s, d: source.panel(source.order_bars(s, d)).select("instrument", "date", "bar_ix", *source.FIELDS), f"{WITH} SELECT instrument, date, bar_ix, open, high, low, close, volume FROM panel")
add(
    "io1_item_bars",
    lambda s, d: source.item_bars(s, d),
    """WITH raw AS (SELECT *, l_extendedprice / l_quantity AS price FROM lineitem)
SELECT l_returnflag AS instrument, CAST(l_shipdate AS DATE) AS date,
       first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, price) AS open, max(price) AS high, min(price) AS low,
       last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, price) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume
FROM raw GROUP BY 1, 2""",
)
add("io3_load_range", lambda s, d: source.load(source.order_bars(s, d), "1996-01-01", "1996-12-31", ["1-URGENT", "5-LOW"]), f"{WITH} SELECT instrument, date, open, high, low, close, volume FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND instrument IN ('1-URGENT', '5-LOW')")
add("io3_repeated_bars", lambda s, d: source.repeated_bars(source.table(s, d, "orders").select(c("o_orderpriority").alias("instrument"), c("o_orderdate").cast("date").alias("date"))), "SELECT o_orderpriority AS instrument, CAST(o_orderdate AS DATE) AS date, count(*) AS n_rows FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
add("io19_slice_dates", lambda s, d: source.load(source.panel(source.order_bars(s, d)), "1997-03-01", "1997-06-30").select("instrument", "bar_ix", "close"), f"{WITH} SELECT instrument, bar_ix, close FROM panel WHERE date BETWEEN DATE '1997-03-01' AND DATE '1997-06-30'")
add("io20_slice_bars", lambda s, d: source.panel(source.order_bars(s, d)).filter(c("bar_ix").between(10, 59) & c("instrument").isin("2-HIGH", "3-MEDIUM")).select("instrument", "bar_ix", c("close").isNotNull().alias("listed")), f"{WITH} SELECT instrument, bar_ix, close IS NOT NULL AS listed FROM panel WHERE bar_ix BETWEEN 10 AND 59 AND instrument IN ('2-HIGH', '3-MEDIUM')")

# Trailing windows
value("w1_rolling_sum", lambda: w.rolling_sum(c("close"), 13), full("sum", "close", 13))
value("w2_rolling_mean", lambda: w.rolling_mean(c("close"), 13), full("avg", "close", 13))
value("w3_rolling_std", lambda: w.rolling_std(c("close"), 13), full("stddev_samp", "close", 13))
value("w4_rolling_apply", lambda: F.aggregate(w.rolling_list(c("close"), 8), F.lit(0.0), lambda a, v: a + v * v), f"(CASE WHEN count(close) {W(8)} = 8 THEN sum(close * close) {W(8)} END)")
value("w5_rolling_max", lambda: w.rolling_max(c("high"), 13), full("max", "high", 13))
value("w6_rolling_min", lambda: w.rolling_min(c("low"), 13), full("min", "low", 13))
value("w7_shift", lambda: w.shift(c("close"), 3), lagged("close", 3))
value("w8_true_range", lambda: c("tr"), "tr")

# Transforms
_mean20, _std20 = full("avg", "close", 20), full("stddev_samp", "close", 20)
_z20 = f"(CASE WHEN {_std20} = 0 THEN 0 ELSE (close - {_mean20}) / {_std20} END)"
value("t1_rolling_mean", lambda: w.rolling_mean(c("close"), 20), _mean20)
value("t2_rolling_std", lambda: w.rolling_std(c("close"), 20), _std20)
value("t8_zscore", lambda: transforms.zscore(c("close")), _z20)
add(
    "t9_percent_rank",
    lambda s, d: base(s, d).select("instrument", "bar_ix", transforms.percent_rank(c("close")).alias("value")),
    f"{WITH} SELECT a.instrument, a.bar_ix, CASE WHEN a.bar_ix >= 19 AND a.close IS NOT NULL THEN count(b.close) FILTER (b.close <= a.close) / 20.0 END AS value FROM p a JOIN p b ON b.instrument = a.instrument AND b.bar_ix BETWEEN a.bar_ix - 19 AND a.bar_ix GROUP BY a.instrument, a.bar_ix, a.close",
)
_roc = lambda n: f"(CASE WHEN {lagged('close', n)} <> 0 THEN close / {lagged('close', n)} - 1 END)"
value("t10_roc", lambda: transforms.roc(c("close"), 10), _roc(10))
value("t11_log_return", lambda: transforms.log_return(c("close")), f"(CASE WHEN close > 0 AND {lagged('close')} > 0 THEN ln(close / {lagged('close')}) END)")
_fd = transforms.frac_diff_weights(0.4, 1e-2, 50)
value("t12_frac_diff", lambda: transforms.frac_diff(c("close"), 0.4, 1e-2, 50), "(" + " + ".join(f"({v!r}) * {lagged('close', k)}" if k else f"({v!r}) * close" for k, v in enumerate(_fd)) + ")")
value("t14_wavelet_detail", lambda: transforms.wavelet_detail(c("close"), 16, 2), f"(CASE WHEN count(close) {W(16)} = 16 THEN {full('avg', 'close', 2)} - {full('avg', 'close', 4)} END)")


def _state(name: str, inputs: list[str], step: Callable[[], state.Step], sql: str | None) -> None:
    add(name, lambda s, d: state.run_steps(base(s, d), inputs, step(), "value").select("instrument", "bar_ix", "value"), sql)


def _recursive(seed: str, n: int, nxt: str, x: str = "close") -> str:
    """A recursion seeded with the mean of the first n bars, over a series without gaps."""
    return f"""WITH RECURSIVE {PANEL},
r(instrument, bar_ix, v) AS (SELECT instrument, CAST({n - 1} AS BIGINT), {seed} FROM p WHERE bar_ix < {n} GROUP BY instrument
  UNION ALL SELECT p.instrument, p.bar_ix, {nxt} FROM r JOIN p ON p.instrument = r.instrument AND p.bar_ix = r.bar_ix + 1)
SELECT p.instrument, p.bar_ix, r.v AS value FROM p LEFT JOIN r ON r.instrument = p.instrument AND r.bar_ix = p.bar_ix"""


_whole = lambda n: f"CASE WHEN count(close) = {n} THEN avg(close) END"
_state("t3_ema", ["close"], lambda: state.ema(10), _recursive(_whole(10), 10, f"{2 / 11!r} * p.close + {1 - 2 / 11!r} * r.v"))
_JB = 0.45 * 13 / (0.45 * 13 + 2)
_JA = _JB**2
_state(
    "t4_jma",
    ["close"],
    state.jma,
    f"""WITH RECURSIVE {PANEL},
r(instrument, bar_ix, sm, lg, sp, v) AS (SELECT instrument, CAST(13 AS BIGINT), {_whole(14)}, {_whole(14)}, CAST(0 AS DOUBLE), {_whole(14)} FROM p WHERE bar_ix < 14 GROUP BY instrument
  UNION ALL SELECT instrument, bar_ix, sm, lg, sp, v + sp FROM (SELECT instrument, bar_ix, sm, lg, (sm + 1.5 * lg - v) * {(1 - _JA) ** 2!r} + {_JA**2!r} * sp AS sp, v FROM
    (SELECT p.instrument, p.bar_ix, {1 - _JA!r} * p.close + {_JA!r} * r.sm AS sm, {1 - _JB!r} * (p.close - ({1 - _JA!r} * p.close + {_JA!r} * r.sm)) + {_JB!r} * r.lg AS lg, r.sp, r.v FROM r JOIN p ON p.instrument = r.instrument AND p.bar_ix = r.bar_ix + 1)))
SELECT p.instrument, p.bar_ix, r.v AS value FROM p LEFT JOIN r ON r.instrument = p.instrument AND r.bar_ix = p.bar_ix""",
)
_state(
    "t5_kalman",
    ["close"],
    state.kalman,
    f"""WITH RECURSIVE {PANEL},
r(instrument, bar_ix, v, cov) AS (SELECT instrument, bar_ix, close, CAST(1.0 AS DOUBLE) FROM p WHERE bar_ix = 0
  UNION ALL SELECT p.instrument, p.bar_ix, r.v + (r.cov + 1e-4) / (r.cov + 1e-4 + 1e-2) * (p.close - r.v), (r.cov + 1e-4) * (1 - (r.cov + 1e-4) / (r.cov + 1e-4 + 1e-2)) FROM r JOIN p ON p.instrument = r.instrument AND p.bar_ix = r.bar_ix + 1)
SELECT instrument, bar_ix, v AS value FROM r""",
)
# The same in blocks of 64 bars, as a series too long for one task is run
for _name, _linear in (("t3_ema", state.linear_ema(10)), ("t4_jma", state.linear_jma()), ("t5_kalman", state.linear_kalman())):
    add(f"{_name}_in_blocks", lambda s, d, x=_linear: state.run_linear(base(s, d), ["close"], x, "value", block=64).select("instrument", "bar_ix", "value"), SQL[_name])
_ATR = """,
tv AS (SELECT instrument, bar_ix, tr, row_number() OVER (PARTITION BY instrument ORDER BY bar_ix) AS k FROM p WHERE tr IS NOT NULL),
r(instrument, k, v) AS (SELECT instrument, CAST(14 AS BIGINT), avg(tr) FROM tv WHERE k <= 14 GROUP BY instrument HAVING count(*) = 14
  UNION ALL SELECT tv.instrument, tv.k, (r.v * 13 + tv.tr) / 14 FROM r JOIN tv ON tv.instrument = r.instrument AND tv.k = r.k + 1),
av AS (SELECT p.*, last_value(r.v IGNORE NULLS) OVER (PARTITION BY p.instrument ORDER BY p.bar_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS atr
       FROM p LEFT JOIN tv ON tv.instrument = p.instrument AND tv.bar_ix = p.bar_ix LEFT JOIN r ON r.instrument = tv.instrument AND r.k = tv.k)"""
WITH_ATR = "WITH RECURSIVE " + PANEL + _ATR


def with_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.run_steps(base(spark, sf_dir), ["tr"], state.wilder(14), "atr")


_state("w9_wilder", ["tr"], state.wilder, f"{WITH_ATR} SELECT instrument, bar_ix, atr AS value FROM av")
add("w9_wilder_in_blocks", lambda s, d: state.run_linear(base(s, d), ["tr"], state.linear_wilder(14), "value", block=10).select("instrument", "bar_ix", "value"), SQL["w9_wilder"])  # the seed takes two blocks
add("t6_atr", lambda s, d: with_atr(s, d).select("instrument", "bar_ix", c("atr").alias("value")), f"{WITH_ATR} SELECT instrument, bar_ix, atr AS value FROM av")
add("t7_atr_normalise", lambda s, d: with_atr(s, d).select("instrument", "bar_ix", F.when(c("atr") > 0, c("close") / c("atr")).alias("value")), f"{WITH_ATR} SELECT instrument, bar_ix, CASE WHEN atr > 0 THEN close / atr END AS value FROM av")

# Signals
_dir = lambda up, down, *known: "(CASE WHEN " + " AND ".join(f"{k} IS NOT NULL" for k in known) + f" THEN CASE WHEN {up} THEN 1.0 WHEN {down} THEN -1.0 ELSE 0.0 END END)"
_fast, _slow = full("avg", "close", 4), full("avg", "close", 13)
_gap = f"(({_fast} - {_slow}) / {_slow})"
value("s1_crossover", lambda: signals.crossover(w.rolling_mean(c("close"), 4), w.rolling_mean(c("close"), 13), 0.02), _dir(f"{_gap} > 0.02", f"{_gap} < -0.02", _gap))
value("s2_threshold", lambda: signals.threshold(transforms.zscore(c("close")), 0.5, -0.5), _dir(f"{_z20} > 0.5", f"{_z20} < -0.5", _z20))
_before = "OVER (PARTITION BY instrument ORDER BY bar_ix ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)"
_top, _bottom = f"(CASE WHEN count(high) {_before} = 8 THEN max(high) {_before} END)", f"(CASE WHEN count(low) {_before} = 8 THEN min(low) {_before} END)"
value("s3_breakout", lambda: signals.breakout(c("high"), c("low"), c("close"), 8), _dir(f"close > {_top}", f"close < {_bottom}", "close", _top, _bottom))
add(
    "s4_vol_expansion",
    lambda s, d: with_atr(s, d).select("instrument", "bar_ix", signals.vol_expansion(c("atr"), 10).alias("value")),
    f"{WITH_ATR} SELECT instrument, bar_ix, {_dir('atr > ' + full('avg', 'atr', 10), 'false', 'atr', full('avg', 'atr', 10))} AS value FROM av",
)
value("s5_momentum", lambda: signals.momentum(c("close"), 8, 0.05), _dir(f"{_roc(8)} > 0.05", f"{_roc(8)} < -0.05", _roc(8)))
value("s6_mean_reversion", lambda: signals.mean_reversion(c("close"), 20, 1.0), _dir(f"{_z20} < -1.0", f"{_z20} > 1.0", _z20))
value("s7_volume_confirmation", lambda: signals.volume_confirmation(c("volume"), 8, 1.1), _dir(f"volume > 1.1 * {full('avg', 'volume', 8)}", "false", "volume", full("avg", "volume", 8)))
_sa, _sb = _dir("close > open", "close < open", "open"), _dir("ret > 0.1", "ret < -0.1", "ret")
_a, _b = lambda: signals.crossover(c("close"), c("open")), lambda: signals.threshold(c("ret"), 0.1, -0.1)
value("s8_and", lambda: signals.both(_a(), _b()), _dir(f"{_sa} > 0 AND {_sb} > 0", f"{_sa} < 0 AND {_sb} < 0", _sa, _sb))
value("s9_or", lambda: signals.either(_a(), _b()), f"greatest(-1, least(1, sign({_sa}) + sign({_sb}))) + 0 * {_sa} + 0 * {_sb}")
value("s10_not", lambda: signals.negate(_a()), _dir(f"{_sa} = 0", "false", _sa))

# Roles of a spec
_entry = lambda: signals.crossover(w.rolling_mean(c("close"), 4), w.rolling_mean(c("close"), 13))
_e = _dir(f"{_gap} > 0", f"{_gap} < 0", _gap)
value("c2_combine_entries", lambda: signals.combine_entries([_a(), _b()]), f"CASE WHEN coalesce({_sa}, 0) > 0 AND coalesce({_sb}, 0) > 0 THEN 1.0 WHEN coalesce({_sa}, 0) < 0 AND coalesce({_sb}, 0) < 0 THEN -1.0 ELSE 0.0 END")
value("c2_combine_filters", lambda: signals.combine_filters([_a(), _b()]), f"CASE WHEN coalesce({_sa}, 0) > 0 AND coalesce({_sb}, 0) > 0 THEN 1.0 ELSE 0.0 END")
value("c2_combine_exits", lambda: signals.combine_exits([_a(), _b()]), f"CASE WHEN coalesce({_sa}, 0) <> 0 OR coalesce({_sb}, 0) <> 0 THEN 1.0 ELSE 0.0 END")
value("c3_exit_roles", lambda: signals.apply_roles(_entry(), exits=[_b()]), f"CASE WHEN coalesce({_sb} = 0, false) THEN coalesce({_e}, 0) ELSE 0.0 END")
value("c4_filter_roles", lambda: signals.apply_roles(_entry(), filters=[_b()]), f"CASE WHEN coalesce({_sb}, 0) > 0 THEN coalesce({_e}, 0) ELSE 0.0 END")
value("c6_clip", lambda: signals.apply_roles(c("ret") * 3), "greatest(-1, least(1, coalesce(ret * 3, 0)))")
value("c7_price_returns", lambda: c("ret"), "ret")

# Risk
_pos = lambda s, d: base(s, d).withColumn("position", F.coalesce(_entry(), F.lit(0.0)))
WITH_POS = f"{WITH}, q AS (SELECT *, coalesce({_e}, 0) AS position FROM p)"


def sized(name: str, column: Callable[[], Column], sql: str) -> None:
    add(name, lambda s, d: _pos(s, d).select("instrument", "bar_ix", column().alias("value")), f"{WITH_POS} SELECT instrument, bar_ix, {sql} AS value FROM q")


sized("r6_entries", lambda: risk.entries(c("position")), f"CASE WHEN position <> 0 AND sign(position) <> coalesce({lagged('sign(position)')}, 0) THEN 1.0 ELSE 0.0 END")
_rs = full("stddev_samp", "ret", 26)
sized("r4_vol_target", lambda: risk.vol_target(c("position"), c("ret"), 26, 0.5, 2.0), f"position * greatest(0, CASE WHEN {_rs} > 0 THEN least(2.0, 0.5 / {_rs}) END)")
_rm = full("avg", "ret", 26)
sized("r5_kelly", lambda: risk.kelly(c("position"), c("ret"), 26), f"position * abs(CASE WHEN {_rs} > 0 THEN greatest(-1, least(1, 0.25 * {_rm} / ({_rs} * {_rs}))) END)")
add(
    "r3_time_stop",
    lambda s, d: risk.time_stop(_pos(s, d), "position", "value", 3).select("instrument", "bar_ix", "value"),
    f"""{WITH_POS}, n AS (SELECT *, CASE WHEN sign(position) <> coalesce({lagged('sign(position)')}, 0) THEN 1 ELSE 0 END AS new FROM q),
i AS (SELECT *, sum(new) OVER (PARTITION BY instrument ORDER BY bar_ix) AS island FROM n)
SELECT instrument, bar_ix, CASE WHEN position <> 0 AND row_number() OVER (PARTITION BY instrument, island ORDER BY bar_ix) % 4 = 0 THEN 0.0 ELSE position END AS value FROM i""",
)
_stopped = lambda s, d: with_atr(s, d).withColumn("position", F.coalesce(_entry(), F.lit(0.0)))
_ST = f"{WITH_ATR}, st AS (SELECT av.*, coalesce({_e}, 0) AS position FROM av)".replace(" AND close", " AND close")


def _stop_sql(name: str, source: str, multiple: float) -> str:
    """A stop that stays where it was set at entry."""
    fresh, hit = "(sign(x.position) <> s.bef OR s.side = 0 OR s.stop IS NULL)", "coalesce((x.close - s.stop) * s.side <= 0, false)"
    return f"""{name}(instrument, bar_ix, side, stop, bef, value) AS (SELECT DISTINCT instrument, CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE) FROM p
  UNION ALL SELECT x.instrument, x.bar_ix, CASE WHEN x.position = 0 THEN 0 WHEN {fresh} THEN sign(x.position) WHEN {hit} THEN 0 ELSE s.side END, CASE WHEN x.position = 0 THEN NULL WHEN {fresh} THEN x.close - sign(x.position) * {multiple} * x.atr WHEN {hit} THEN NULL ELSE s.stop END,
    CASE WHEN x.position = 0 THEN 0 ELSE sign(x.position) END, CASE WHEN x.atr IS NULL THEN NULL WHEN x.position <> 0 AND NOT {fresh} AND {hit} THEN 0 ELSE x.position END FROM {name} s JOIN {source} x ON x.instrument = s.instrument AND x.bar_ix = s.bar_ix + 1)"""


def _trail_sql(name: str, source: str, multiple: float) -> str:
    """A stop that follows the best close and only tightens."""
    fresh = "(s.side = 0 OR sign(x.position) <> s.side)"
    best = "CASE WHEN x.close IS NULL THEN s.best WHEN s.best IS NULL THEN x.close ELSE s.side * greatest(s.side * s.best, s.side * x.close) END"
    return f"""{name}(instrument, bar_ix, side, best, stop, value) AS (SELECT DISTINCT instrument, CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM p
  UNION ALL SELECT instrument, bar_ix, CASE WHEN flat OR hit THEN 0 WHEN fresh THEN now ELSE side END, CASE WHEN flat OR hit THEN NULL WHEN fresh THEN close ELSE best END, CASE WHEN flat OR hit THEN NULL WHEN fresh THEN close - now * {multiple} * atr ELSE stop END, CASE WHEN atr IS NULL THEN NULL WHEN hit THEN 0 ELSE position END
  FROM (SELECT *, NOT flat AND NOT fresh AND coalesce((close - stop) * side <= 0, false) AS hit FROM (SELECT *, CASE WHEN atr IS NULL OR best IS NULL THEN old ELSE CASE WHEN old IS NULL THEN best - side * {multiple} * atr ELSE side * greatest(side * old, side * (best - side * {multiple} * atr)) END END AS stop
    FROM (SELECT x.instrument, x.bar_ix, x.position, x.close, x.atr, sign(x.position) AS now, coalesce(x.position = 0, true) AS flat, {fresh} AS fresh, s.side, s.stop AS old, {best} AS best FROM {name} s JOIN {source} x ON x.instrument = s.instrument AND x.bar_ix = s.bar_ix + 1))))"""


add("r1_atr_stop", lambda s, d: state.run_steps(_stopped(s, d), ["position", "close", "atr"], state.atr_stop(0.5), "value").select("instrument", "bar_ix", "value"), f"{_ST}, {_stop_sql('s1', 'st', 0.5)} SELECT instrument, bar_ix, value FROM s1 WHERE bar_ix >= 0")
add("r2_trailing_stop", lambda s, d: state.run_steps(_stopped(s, d), ["position", "close", "atr"], state.trailing_stop(0.5), "value").select("instrument", "bar_ix", "value"), f"{_ST}, {_trail_sql('s2', 'st', 0.5)} SELECT instrument, bar_ix, value FROM s2 WHERE bar_ix >= 0")
add(
    "c5_risk_chain",
    lambda s, d: state.run_steps(state.run_steps(_stopped(s, d), ["position", "close", "atr"], state.atr_stop(0.5), "kept"), ["kept", "close", "atr"], state.trailing_stop(1.0), "value").select("instrument", "bar_ix", F.coalesce("value", F.lit(0.0)).alias("value")),
    f"{_ST}, {_stop_sql('s1', 'st', 0.5)}, kp AS (SELECT st.instrument, st.bar_ix, s1.value AS position, st.close, st.atr FROM st JOIN s1 ON s1.instrument = st.instrument AND s1.bar_ix = st.bar_ix), {_trail_sql('s2', 'kp', 1.0)} SELECT instrument, bar_ix, coalesce(value, 0) AS value FROM s2 WHERE bar_ix >= 0",
)

# Weights
value("p1_equal_weight", lambda: weights.equal_weight(c("ret")), "CASE WHEN count(ret) OVER (PARTITION BY date) > 0 THEN CASE WHEN ret IS NULL THEN 0.0 ELSE 1.0 / count(ret) OVER (PARTITION BY date) END END")
value("p4_normalise", lambda: weights.normalise(c("ret")), "CASE WHEN sum(abs(ret)) OVER (PARTITION BY date) > 0 THEN ret / sum(abs(ret)) OVER (PARTITION BY date) END")
add(
    "p2_risk_parity",
    lambda s, d: weights.risk_parity(base(s, d), "ret", 26, "value").select("instrument", "bar_ix", "value"),
    f"{WITH}, v AS (SELECT *, coalesce(CASE WHEN stddev_samp(ret) {W(26)} > 0 THEN 1 / stddev_samp(ret) {W(26)} END, 0) AS inv FROM p) SELECT instrument, bar_ix, CASE WHEN bar_ix >= 25 AND sum(inv) OVER (PARTITION BY date) > 0 THEN inv / sum(inv) OVER (PARTITION BY date) END AS value FROM v",
)

# Backtest
_signal = lambda s, d: base(s, d).withColumn("signal", _entry())
_RATE = (10.0 + 1.5 + 0.297 + 0.01 + 3.0 + 5.0 + 0.18 * (3.0 + 0.297 + 0.01)) / 10_000
WITH_RUN = f"""{WITH}, sg AS (SELECT *, {_e} AS signal FROM p),
b1 AS (SELECT *, CASE WHEN close IS NULL THEN 0.0 ELSE greatest(-1, least(1, coalesce({lagged('signal')}, 0))) END AS w1 FROM sg),
b2 AS (SELECT *, CASE WHEN sum(abs(w1)) OVER (PARTITION BY date) > 1 THEN w1 / sum(abs(w1)) OVER (PARTITION BY date) ELSE w1 END AS weight FROM b1),
b3 AS (SELECT *, coalesce({lagged('weight')}, 0) AS old FROM b2),
b4 AS (SELECT *, CASE WHEN weight * old > 0 THEN sign(weight) * least(abs(weight), abs(old)) ELSE 0 END AS held FROM b3),
b5 AS (SELECT *, weight - held AS opened, old - held AS closed, close / prev - 1 AS hold_ret FROM b4),
b6 AS (SELECT *, CASE WHEN held = 0 THEN 0.0 ELSE coalesce(held * hold_ret, 0) END + CASE WHEN opened = 0 THEN 0.0 ELSE coalesce(opened * hold_ret, 0) END AS gross, (abs(opened) + abs(closed)) * {_RATE!r} AS cost FROM b5),
b AS (SELECT *, gross - cost AS net FROM b6),
curve AS (SELECT date, bar_ix, sum(gross) AS gross, sum(cost) AS cost, sum(net) AS net, sum(abs(weight)) AS exposure FROM b WHERE bar_ix > 0 GROUP BY date, bar_ix),
eq AS (SELECT *, product(1 + net) OVER (ORDER BY bar_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM curve),
dd AS (SELECT *, equity / max(equity) OVER (ORDER BY bar_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM eq)"""


def bars_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.run(_signal(spark, sf_dir))


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.portfolio(bars_run(spark, sf_dir))


add("b1_lag_and_cap", lambda s, d: bars_run(s, d).select("instrument", "bar_ix", "weight"), f"{WITH_RUN} SELECT instrument, bar_ix, weight FROM b")
add("b3_traded_split", lambda s, d: bars_run(s, d).select("instrument", "bar_ix", "held", "opened", "closed"), f"{WITH_RUN} SELECT instrument, bar_ix, held, opened, closed FROM b")
add("b5_costs", lambda s, d: bars_run(s, d).select("instrument", "bar_ix", "cost"), f"{WITH_RUN} SELECT instrument, bar_ix, cost FROM b")
for _model, _fill in (("bar_close", "prev"), ("next_open", "open"), ("vwap", "(high + low + close) / 3")):
    add(f"b8_fill_{_model}", lambda s, d, m=_model: base(s, d).select("instrument", "bar_ix", backtest.fill_price(m).alias("fill")), f"{WITH} SELECT instrument, bar_ix, {_fill} AS fill FROM p")
add("b9_returns", lambda s, d: backtest.with_returns(base(s, d), "next_open").select("instrument", "bar_ix", "hold_ret", "entry_ret", "exit_ret"), f"{WITH} SELECT instrument, bar_ix, close / prev - 1 AS hold_ret, close / open - 1 AS entry_ret, open / prev - 1 AS exit_ret FROM p")
add("b10_gross", lambda s, d: bars_run(s, d).select("instrument", "bar_ix", "gross", "net", "non_finite"), f"{WITH_RUN} SELECT instrument, bar_ix, gross, net, CASE WHEN held <> 0 AND hold_ret IS NULL THEN 1 ELSE 0 END + CASE WHEN opened <> 0 AND hold_ret IS NULL THEN 1 ELSE 0 END + CASE WHEN closed <> 0 AND prev IS NULL THEN 1 ELSE 0 END AS non_finite FROM b")
add("b12_equity", lambda s, d: backtest.equity(curve(s, d)).select("date", "net", "equity", "drawdown", "exposure", "cost"), f"{WITH_RUN} SELECT date, net, equity, drawdown, exposure, cost FROM dd")
add("b13_max_drawdown", lambda s, d: backtest.equity(curve(s, d)).agg((-F.min("drawdown")).alias("max_drawdown")), f"{WITH_RUN} SELECT -min(drawdown) AS max_drawdown FROM dd")
_TC = f"""{WITH_RUN}, k AS (SELECT *, sign(weight) <> 0 AND sign(weight) <> coalesce({lagged('sign(weight)')}, 0) AS enters FROM b WHERE bar_ix > 0),
tc AS (SELECT instrument, count(*) FILTER (enters) AS n_trades, sum(net) AS pnl, count(*) FILTER (weight <> 0) AS bars_in FROM k GROUP BY instrument)"""
add("b14_trade_counts", lambda s, d: backtest.trade_counts(bars_run(s, d)), f"{_TC} SELECT * FROM tc")
add("b15_instrument_pnl", lambda s, d: backtest.trade_counts(bars_run(s, d)).select("instrument", "pnl"), f"{_TC} SELECT instrument, pnl FROM tc")
add("b16_turnover", lambda s, d: backtest.turnover(bars_run(s, d)), f"{WITH_RUN}, k AS (SELECT *, abs(weight - coalesce({lagged('weight')}, 0)) AS move FROM b WHERE bar_ix > 0), g AS (SELECT date, sum(move) AS move, sum(abs(weight)) AS gross FROM k GROUP BY date) SELECT sum(move) AS turnover, avg(gross) AS exposure FROM g")
_TRADES = f"""{WITH_RUN}, k AS (SELECT *, sign(weight) AS side, lead(date) OVER (PARTITION BY instrument ORDER BY bar_ix) AS nxt FROM b WHERE bar_ix > 0),
k2 AS (SELECT *, CASE WHEN side <> coalesce({lagged('side')}, 0) THEN 1 ELSE 0 END AS new FROM k),
k3 AS (SELECT *, sum(new) OVER (PARTITION BY instrument ORDER BY bar_ix) AS island FROM k2),
trades AS (SELECT instrument, CAST(side AS INTEGER) AS side, min(date) AS entry_date, coalesce(last(nxt ORDER BY bar_ix), max(date)) AS exit_date, count(*) AS bars_held, avg(abs(weight)) AS weight,
                  sum(gross) AS gross_return, sum(cost) AS cost_return, sum(net) AS net_return, last(nxt ORDER BY bar_ix) IS NULL AS open_at_end
           FROM k3 WHERE side <> 0 GROUP BY instrument, island, side)"""
add("b17_trades", lambda s, d: backtest.trades(bars_run(s, d)), f"{_TRADES} SELECT * FROM trades")
add("b18_closed_trades", lambda s, d: backtest.trades(bars_run(s, d)).filter("NOT open_at_end").select("instrument", "entry_date", "net_return"), f"{_TRADES} SELECT instrument, entry_date, net_return FROM trades WHERE NOT open_at_end")
add("b21_holding_period", lambda s, d: backtest.holding_period(backtest.trade_counts(bars_run(s, d)), 300).select("instrument", "holding"), f"{_TC} SELECT instrument, CASE WHEN n_trades = 0 THEN 5.0 ELSE greatest(1.0, least(60.0, 300 / n_trades)) END AS holding FROM tc")
add(
    "b22_cost_model",
    lambda s, d: backtest.with_cost_model(source.table(s, d, "customer").select(c("c_mktsegment").alias("market"), F.lit("equity").alias("asset_class")).distinct(), backtest.cost_models(s, [("BUILDING", "equity", 12.0), ("MACHINERY", "equity", 7.5)])),
    "SELECT DISTINCT c_mktsegment AS market, 'equity' AS asset_class, coalesce(m.bps, 25.0) AS bps, m.bps IS NULL AS is_placeholder FROM customer LEFT JOIN (VALUES ('BUILDING', 12.0), ('MACHINERY', 7.5)) m(market, bps) ON m.market = c_mktsegment",
)

# Metrics
_SHARPE = f"coalesce(CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt({PERIODS}) END, 0)"
add(
    "m1_summary",
    lambda s, d: metrics.summary(curve(s, d), PERIODS),
    f"""{WITH_RUN}, m AS (SELECT count(*) AS n_bars, {_SHARPE} AS sharpe,
coalesce(CASE WHEN stddev_samp(net) FILTER (net < 0) > 0 THEN avg(net) / stddev_samp(net) FILTER (net < 0) * sqrt({PERIODS}) END, 0) AS sortino,
product(1 + net) - 1 AS total_return, -min(drawdown) AS max_drawdown, coalesce(-avg(drawdown) FILTER (drawdown < 0), 0) AS avg_drawdown FROM dd),
m2 AS (SELECT *, CASE WHEN total_return > -1 THEN pow(1 + total_return, {PERIODS} / n_bars) - 1 ELSE 0.0 END AS cagr FROM m)
SELECT *, CASE WHEN max_drawdown > 0 THEN cagr / max_drawdown ELSE 0 END AS calmar FROM m2""",
)
add("m5_drawdown_series", lambda s, d: backtest.equity(curve(s, d)).select("date", "drawdown"), f"{WITH_RUN} SELECT date, drawdown FROM dd")
add(
    "m6_underwater",
    lambda s, d: metrics.longest_underwater(curve(s, d)),
    f"""{WITH_RUN}, u AS (SELECT *, drawdown < 0 AS under, lead(date) OVER (ORDER BY bar_ix) AS nxt FROM dd), u2 AS (SELECT *, CASE WHEN under <> coalesce(lag(under) OVER (ORDER BY bar_ix), false) THEN 1 ELSE 0 END AS new FROM u),
u3 AS (SELECT *, sum(new) OVER (ORDER BY bar_ix) AS island FROM u2), u4 AS (SELECT island, min(date) AS a, last(coalesce(nxt, date) ORDER BY bar_ix) AS z FROM u3 WHERE under GROUP BY island)
SELECT coalesce(max(date_diff('day', a, z)), 0) AS underwater_days FROM u4""",
)
add(
    "m7_trade_summary",
    lambda s, d: metrics.trade_summary(backtest.trades(bars_run(s, d)), ("instrument",)),
    f"""{_TRADES}, t AS (SELECT *, CASE WHEN NOT open_at_end THEN net_return END AS n FROM trades)
SELECT instrument, count(*) AS trade_count, count(*) FILTER (NOT open_at_end) AS closed_count, CASE WHEN sum(-n) FILTER (n < 0) > 0 THEN coalesce(sum(n) FILTER (n > 0), 0) / sum(-n) FILTER (n < 0) ELSE 0 END AS profit_factor,
coalesce(count(*) FILTER (n > 0) / nullif(count(n), 0), 0) AS win_rate, coalesce(avg(n), 0) AS expectancy FROM t GROUP BY instrument""",
)
add(
    "m10_outliers",
    lambda s, d: metrics.outliers(curve(s, d)),
    f"""{WITH_RUN}, k AS (SELECT *, row_number() OVER (ORDER BY net DESC, bar_ix) AS k, count(*) OVER () AS n FROM curve)
SELECT max(net) AS best_bar, min(net) AS worst_bar, CASE WHEN sum(net) <> 0 THEN sum(CASE WHEN k <= 5 THEN net ELSE 0 END) / sum(net) END AS top5_share,
CASE WHEN sum(net) <> 0 THEN sum(CASE WHEN k <= greatest(1, floor(n * 0.05)) THEN net ELSE 0 END) / sum(net) END AS top_5pct_share FROM k""",
)
add(
    "m12_histogram",
    lambda s, d: metrics.histogram(curve(s, d)),
    f"{WITH_RUN}, e AS (SELECT min(net) AS a, max(net) AS z FROM curve) SELECT CAST(least(23, floor((net - a) / ((z - a) / 24))) AS INTEGER) AS bin, count(*) AS n FROM curve, e GROUP BY 1",
)
