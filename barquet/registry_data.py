"""Registered queries: adjustment, universe and data quality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import barquality as q
from .registry import WITH, add, c
from .shared import new_path
from .sources import archive, snapshots
from .sources import bars as source

D = dt.date
ACTIONS = [("1-URGENT", "split", "1:2", D(1997, 3, 10), "a"), ("1-URGENT", "bonus", "1:1", D(1999, 5, 3), "a"), ("5-LOW", "consolidation", "5:1", D(1998, 1, 5), "b"), ("2-HIGH", "dividend", None, D(1998, 6, 1), "b")]
MEMBERS = [("1-URGENT", D(1995, 1, 1), None), ("2-HIGH", D(1996, 6, 3), D(1998, 6, 1)), ("2-HIGH", D(1998, 1, 5), D(1999, 1, 4)), ("5-LOW", D(1997, 1, 6), D(1997, 1, 6))]


def _bars(s: SparkSession, d: str) -> DataFrame:
    return source.order_bars(s, d)


def _volumes(s: SparkSession, d: str) -> DataFrame:
    """The bars with some volumes unknown, some negative and some zero."""
    return _bars(s, d).withColumn("volume", F.when(c("volume") % 7 == 0, None).when(c("volume") % 11 == 0, -1.0).otherwise(c("volume") - 4))


def _actions(s: SparkSession) -> DataFrame:
    frame = s.createDataFrame(ACTIONS, "instrument string, action_type string, terms string, ex_date date, verified_by string")
    return q.select_actions(frame).withColumn("ratio", q.ratio(c("action_type"), c("terms")))


def _members(s: SparkSession) -> DataFrame:
    return s.createDataFrame(MEMBERS, "instrument string, effective_from date, effective_to date")


_v = lambda x: "NULL" if x is None else f"DATE '{x}'" if isinstance(x, D) else f"'{x}'"
ACT = "acts AS (SELECT instrument, ex_date, CASE action_type WHEN 'bonus' THEN b / (a + b) ELSE a / b END AS ratio FROM (SELECT instrument, action_type, ex_date, CAST(split_part(terms, ':', 1) AS DOUBLE) AS a, CAST(split_part(terms, ':', 2) AS DOUBLE) AS b FROM (VALUES " + ", ".join("(" + ", ".join(map(_v, x)) + ")" for x in ACTIONS) + ") v(instrument, action_type, terms, ex_date, verified_by) WHERE action_type <> 'dividend'))"
MEM = "mem AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_v, x)) + ")" for x in MEMBERS) + ") v(instrument, effective_from, effective_to))"
BASE = f"{WITH}, {ACT}, {MEM}, vol AS (SELECT instrument, date, CASE WHEN volume % 7 = 0 THEN NULL WHEN volume % 11 = 0 THEN -1 ELSE volume - 4 END AS volume FROM bars), lb AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY date) AS pc, lag(date) OVER (PARTITION BY instrument ORDER BY date) AS pd FROM bars)"

add("d1_adjust", lambda s, d: q.adjust(_bars(s, d), _actions(s)), f"{BASE}, f AS (SELECT b.*, coalesce((SELECT product(ratio) FROM acts a WHERE a.instrument = b.instrument AND a.ex_date > b.date), 1.0) AS factor FROM bars b) SELECT instrument, date, open * factor AS open, high * factor AS high, low * factor AS low, close * factor AS close, volume / factor AS volume, factor FROM f")
add("d3_ratio", lambda s, d: _bars(s, d).select("instrument").distinct().join(_actions(s), "instrument").select("instrument", "ex_date", "ratio"), f"{BASE} SELECT instrument, ex_date, ratio FROM acts")
add("d4_dividend_ratio", lambda s, d: _bars(s, d).select("instrument", "date", q.dividend_ratio(c("close"), F.lit(5.0)).alias("ratio")), f"{BASE} SELECT instrument, date, CASE WHEN close > 5 THEN (close - 5) / close END AS ratio FROM bars")
add("d6_members", lambda s, d: q.members(_members(s), "1998-03-02").join(_bars(s, d).groupBy("instrument").agg(F.count("*").alias("n_bars")), "instrument"), f"{BASE} SELECT instrument, count(*) AS n_bars FROM bars WHERE instrument IN (SELECT instrument FROM mem WHERE effective_from <= DATE '1998-03-02' AND (effective_to IS NULL OR effective_to > DATE '1998-03-02')) GROUP BY instrument")
add("d7_ever_members", lambda s, d: _bars(s, d).select("instrument").distinct().join(_members(s).select("instrument").distinct(), "instrument"), f"{BASE} SELECT DISTINCT instrument FROM mem")
add("d8_point_in_time", lambda s, d: q.point_in_time(_bars(s, d), _members(s)).select("instrument", "date", "close"), f"{BASE} SELECT instrument, date, close FROM bars b WHERE EXISTS (SELECT 1 FROM mem m WHERE m.instrument = b.instrument AND b.date >= effective_from AND (effective_to IS NULL OR b.date < effective_to))")
add("d9_overlaps", lambda s, d: q.overlaps(_members(s).join(_bars(s, d).select("instrument").distinct(), "instrument")), f"{BASE}, o AS (SELECT *, lag(effective_to) OVER w AS pt, lag(effective_from) OVER w AS prev_from FROM mem WINDOW w AS (PARTITION BY instrument ORDER BY effective_from)) SELECT instrument, effective_from, prev_from FROM o WHERE prev_from IS NOT NULL AND (pt IS NULL OR pt > effective_from)")
_J = "SELECT 'unexplained_jump' AS validator, instrument, date, close / pc - 1 AS detail FROM lb WHERE abs(close / pc - 1) > 0.3 AND NOT EXISTS (SELECT 1 FROM acts a WHERE a.instrument = lb.instrument AND abs(date_diff('day', a.ex_date, lb.date)) <= 1)"
_N = "SELECT 'universe_too_narrow' AS validator, CAST(NULL AS VARCHAR) AS instrument, CAST(NULL AS DATE) AS date, CAST(n AS DOUBLE) AS detail FROM (SELECT count(DISTINCT instrument) AS n, date_diff('day', min(date), max(date)) / 365.25 AS y FROM bars) WHERE y >= 3 AND n > 1 AND n < 0.5 * (5 + 2 * y) + 2.5"
_Z = "SELECT 'zero_volume' AS validator, instrument, CAST(NULL AS DATE) AS date, s AS detail FROM (SELECT instrument, count(*) FILTER (volume <= 0) / count(*) AS s FROM vol GROUP BY instrument) WHERE s > 0"
_S = "SELECT 'stale_price' AS validator, instrument, min(date) AS date, CAST(count(*) AS DOUBLE) AS detail FROM (SELECT *, sum(CASE WHEN close = pc THEN 0 ELSE 1 END) OVER (PARTITION BY instrument ORDER BY date) AS run FROM lb) GROUP BY instrument, run HAVING count(*) > 5"
_G = "SELECT 'gap' AS validator, instrument, date, CAST(date_diff('day', pd, date) AS DOUBLE) AS detail FROM lb WHERE date_diff('day', pd, date) > 5"
add("d10_unexplained_jumps", lambda s, d: q.unexplained_jumps(_bars(s, d), _actions(s)), f"{BASE} {_J}")
add("d11_narrow_universe", lambda s, d: q.narrow_universe(_bars(s, d), 5), f"{BASE} {_N}")
add("d12_zero_volume", lambda s, d: q.zero_volume(_volumes(s, d)), f"{BASE} {_Z}")
add("d13_stale_prices", lambda s, d: q.stale_prices(_bars(s, d).withColumn("close", F.floor(c("close") / 200)), 2), f"{BASE}, st AS (SELECT instrument, date, floor(close / 200) AS close FROM bars), sl AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY date) AS pc FROM st) SELECT 'stale_price' AS validator, instrument, min(date) AS date, CAST(count(*) AS DOUBLE) AS detail FROM (SELECT *, sum(CASE WHEN close = pc THEN 0 ELSE 1 END) OVER (PARTITION BY instrument ORDER BY date) AS run FROM sl) GROUP BY instrument, run HAVING count(*) > 2")
add("d14_gaps", lambda s, d: q.gaps(_bars(s, d), 5), f"{BASE} {_G}")
add("d15_validate", lambda s, d: q.validate(_volumes(s, d), _actions(s)), f"{BASE} {_J} UNION ALL {_N} UNION ALL {_Z} UNION ALL {_S} UNION ALL {_G}")

# Actions of orders: kind by priority, verified unless pending
_acts = lambda s, d: source.table(s, d, "orders").select(F.concat(F.lit("i"), c("o_custkey").cast("string")).alias("instrument"), F.when(c("o_orderpriority") == "1-URGENT", "split").when(c("o_orderpriority") == "2-HIGH", "bonus").when(c("o_orderpriority") == "3-MEDIUM", "dividend").otherwise("merger").alias("action_type"), c("o_orderdate").cast("date").alias("ex_date"), (c("o_orderkey") % 9 / 10 + 0.1).alias("ratio"), F.when(c("o_orderstatus") != "P", "desk").alias("verified_by"))
_AC = "a AS (SELECT 'i' || o_custkey AS instrument, CASE o_orderpriority WHEN '1-URGENT' THEN 'split' WHEN '2-HIGH' THEN 'bonus' WHEN '3-MEDIUM' THEN 'dividend' ELSE 'merger' END AS action_type, CAST(o_orderdate AS DATE) AS ex_date, o_orderkey % 9 / 10 + 0.1 AS ratio, CASE WHEN o_orderstatus <> 'P' THEN 'desk' END AS verified_by FROM orders)"
add("d5_selected_actions", lambda s, d: q.select_actions(_acts(s, d), allow_unverified=True).groupBy("instrument", "action_type").agg(F.count("*").alias("n"), F.sum("ratio").alias("total")), f"WITH {_AC} SELECT instrument, action_type, count(*) AS n, sum(ratio) AS total FROM a WHERE action_type IN ('split', 'bonus', 'consolidation') GROUP BY 1, 2")
_ASCHEMA = "instrument string, action_type string, ex_date date, ratio double, verified_by string"


def _through_csv(s: SparkSession, frame: DataFrame, schema: str) -> DataFrame:
    """Written as CSV with a header and imported again."""
    path = new_path(s)
    frame.write.option("header", True).csv(path)
    return archive.import_csv(s, path, schema)


add("io8_imported_actions", lambda s, d: archive.import_summary(_through_csv(s, _acts(s, d), _ASCHEMA)), f"WITH {_AC} SELECT count(*) AS n_rows, count(DISTINCT instrument) AS n_ever, count(*) FILTER (verified_by IS NULL) AS n_unverified FROM a")
add("io9_imported_members", lambda s, d: archive.import_summary(_through_csv(s, _acts(s, d).select("instrument", c("ex_date").alias("effective_from"), F.when(c("verified_by").isNotNull(), F.date_add("ex_date", 90)).alias("effective_to")), "instrument string, effective_from date, effective_to date").filter("effective_to IS NULL OR effective_to > effective_from")), f"WITH {_AC} SELECT count(*) AS n_rows, count(DISTINCT instrument) AS n_ever FROM a")

# Snapshots: one per customer segment and nation; orders are their flags
_snaps = lambda s, d: source.table(s, d, "customer").select(c("c_custkey").alias("snapshot_id"), c("c_mktsegment").alias("market"), c("c_nationkey").alias("timeframe"), c("c_acctbal").alias("period_end"))
_flag = lambda s, d: source.table(s, d, "orders").select(c("o_custkey").alias("snapshot_id"), F.when(c("o_orderstatus") == "O", "pending").when(c("o_orderpriority") == "1-URGENT", "data_error").otherwise("accepted").alias("resolution"))
ST = """WITH fl AS (SELECT o_custkey AS snapshot_id, CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderpriority = '1-URGENT' THEN 'data_error' ELSE 'accepted' END AS resolution FROM orders),
st AS (SELECT c_custkey AS snapshot_id, c_mktsegment AS market, c_nationkey AS timeframe, c_acctbal AS period_end, CASE WHEN count(*) FILTER (resolution = 'pending') > 0 THEN 'pending' WHEN count(*) FILTER (resolution = 'data_error') > 0 THEN 'invalid' ELSE 'valid' END AS status
FROM customer LEFT JOIN fl ON fl.snapshot_id = c_custkey GROUP BY 1, 2, 3, 4)"""
_status = lambda s, d: q.snapshot_status(_snaps(s, d), _flag(s, d))
add("d16_snapshot_status", _status, f"{ST} SELECT * FROM st")
add("d17_latest_usable", lambda s, d: q.latest(_status(s, d).filter("status = 'valid'"), ["market", "timeframe"], [F.desc("period_end"), F.desc("snapshot_id")]).select("market", "timeframe", "snapshot_id"), f"{ST}, k AS (SELECT *, row_number() OVER (PARTITION BY market, timeframe ORDER BY period_end DESC, snapshot_id DESC) AS k FROM st WHERE status = 'valid') SELECT market, timeframe, snapshot_id FROM k WHERE k = 1")
add("d18_pending_flags", lambda s, d: _flag(s, d).filter("resolution = 'pending'").groupBy("snapshot_id").agg(F.count("*").alias("n")), f"{ST} SELECT snapshot_id, count(*) AS n FROM fl WHERE resolution = 'pending' GROUP BY 1")
_fl = lambda s, d: source.table(s, d, "orders").select(c("o_orderkey").alias("flag_id"), F.lit("pending").alias("resolution"))
_vd = lambda s, d: source.table(s, d, "lineitem").groupBy(c("l_orderkey").alias("flag_id"), "l_returnflag").agg(F.max("l_shipdate").alias("resolved_at")).select("flag_id", F.when(c("l_returnflag") == "A", "genuine_move").when(c("l_returnflag") == "N", "missing_action_added").otherwise("data_error").alias("resolution"), F.lit("desk").alias("resolved_by"), "resolved_at")
add("d18_resolved_flags", lambda s, d: q.resolve(_fl(s, d), _vd(s, d)).groupBy("resolution").agg(F.count("*").alias("n"), F.max("resolved_at").alias("newest")), "WITH v AS (SELECT l_orderkey AS flag_id, CASE l_returnflag WHEN 'A' THEN 'genuine_move' WHEN 'N' THEN 'missing_action_added' ELSE 'data_error' END AS resolution, max(l_shipdate) AS tm FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY flag_id ORDER BY tm DESC, resolution) AS k FROM v) SELECT coalesce(k.resolution, 'pending') AS resolution, count(*) AS n, max(tm) AS newest FROM orders LEFT JOIN k ON k.flag_id = o_orderkey AND k.k = 1 GROUP BY 1")


def _tree(s: SparkSession, d: str) -> DataFrame:
    """The bars of each instrument written to its place in a market tree, and found again."""
    root, bars = new_path(s), _bars(s, d)
    for (name,) in bars.select("instrument").distinct().collect():  # five
        own = bars.filter(c("instrument") == name).select("date", c("open").alias("Open"), c("close").alias("Close"))
        own.write.parquet(f"{root}/equities/1w/{name.replace(' ', '_')}.parquet")
    return archive.market_tree(s, root)


add("io2_market_tree", lambda s, d: _tree(s, d).groupBy("asset_class", "timeframe", "instrument").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.sum("close").alias("total")), f"{BASE} SELECT 'equities' AS asset_class, '1w' AS timeframe, replace(instrument, ' ', '_') AS instrument, count(*) AS n, min(date) AS first, sum(close) AS total FROM bars GROUP BY instrument")
add("d19_outside_vault", lambda s, d: q.outside_vault(_bars(s, d), s.createDataFrame([(None, D(1999, 1, 1), D(1999, 12, 31)), ("5-LOW", D(1996, 1, 1), D(1996, 6, 30))], "instrument string, locked_from date, locked_to date")).select("instrument", "date"), f"{BASE} SELECT instrument, date FROM bars WHERE NOT date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' AND NOT (instrument = '5-LOW' AND date BETWEEN DATE '1996-01-01' AND DATE '1996-06-30')")
add("d20_research_range", lambda s, d: q.research_range(_bars(s, d)).select("instrument", "date"), f"{BASE} SELECT instrument, date FROM bars WHERE date < (SELECT CAST(max(date) - to_months(24) AS DATE) + 1 FROM bars)")
add("d21_vault_budget", lambda s, d: source.table(s, d, "customer").groupBy("c_nationkey").agg((F.lit(100) - F.count("*")).alias("opens_left")), "SELECT c_nationkey, 100 - count(*) AS opens_left FROM customer GROUP BY 1")
add("io4_ingest_summary", lambda s, d: _bars(s, d).agg(F.countDistinct("instrument").alias("n_instruments"), F.min("date").alias("period_start"), F.max("date").alias("period_end"), F.count("*").alias("n_bars")), f"{BASE} SELECT count(DISTINCT instrument) AS n_instruments, min(date) AS period_start, max(date) AS period_end, count(*) AS n_bars FROM bars")
add("io5_load_adjusted", lambda s, d: q.point_in_time(q.adjust(_bars(s, d), _actions(s)), _members(s)).select("instrument", "date", "close", "factor"), f"{BASE}, f AS (SELECT b.*, coalesce((SELECT product(ratio) FROM acts a WHERE a.instrument = b.instrument AND a.ex_date > b.date), 1.0) AS factor FROM bars b) SELECT instrument, date, close * factor AS close, factor FROM f WHERE EXISTS (SELECT 1 FROM mem m WHERE m.instrument = f.instrument AND f.date >= effective_from AND (effective_to IS NULL OR f.date < effective_to))")


def _ingested(s: SparkSession, d: str) -> DataFrame:
    """The bars twice, the second time in another order and after a decision: one row."""
    folder = new_path(s)
    bars = _bars(s, d).select(*snapshots.FIELDS)
    first = snapshots.ingest(bars, folder, "orders", "week", "equity")
    snapshots.decide(s, folder, first, "a reviewer", status="valid")
    snapshots.ingest(bars.orderBy("close"), folder, "orders", "week", "equity")
    return snapshots.manifest(s, folder).select("market", "timeframe", "version", "status", "vaulted", "period_start", "period_end", "n_bars", "n_instruments")


def _loaded(s: SparkSession, d: str) -> DataFrame:
    """The newest usable of two snapshots, of which the later one is invalid, from 1996 on."""
    folder = new_path(s)
    bars = _bars(s, d).select(*snapshots.FIELDS)
    good = snapshots.ingest(bars.filter("date < '1998-01-01'"), folder, "orders", "week", "equity")
    bad = snapshots.ingest(bars, folder, "orders", "week", "equity")
    snapshots.decide(s, folder, good, "a reviewer", status="valid")
    snapshots.decide(s, folder, bad, "a reviewer", status="invalid")
    return snapshots.load(s, folder, snapshots.newest_usable(s, folder, "orders", "week", "equity"), start="1996-01-01").select("instrument", "date", "close")


add("io4_ingested_twice", _ingested, f"{BASE} SELECT 'orders' AS market, 'week' AS timeframe, 1 AS version, 'valid' AS status, false AS vaulted, min(date) AS period_start, max(date) AS period_end, count(*) AS n_bars, count(DISTINCT instrument) AS n_instruments FROM bars")
add("io5_load_of_a_snapshot", _loaded, f"{BASE} SELECT instrument, date, close FROM bars WHERE date >= DATE '1996-01-01' AND date < DATE '1998-01-01'")
add("io10_keyed_scan", lambda s, d: source.table(s, d, "orders").filter(c("o_orderstatus").eqNullSafe("F") & c("o_orderpriority").eqNullSafe("5-LOW")).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
add("io11_latest_row_wins", lambda s, d: q.latest(source.table(s, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type"), "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
add("io15_json_columns", lambda s, d: source.table(s, d, "customer").select("c_custkey", F.to_json(F.struct(c("c_mktsegment").alias("market"), c("c_nationkey").alias("nation"))).alias("payload")).select("c_custkey", F.from_json("payload", "market string, nation int")["market"].alias("market"), F.from_json("payload", "market string, nation int")["nation"].alias("nation")), "SELECT c_custkey, c_mktsegment AS market, c_nationkey AS nation FROM customer")
add("io23_freshness", lambda s, d: _snaps(s, d).groupBy("market", "timeframe").agg(F.count("*").alias("n"), F.max("period_end").alias("newest"), F.sum("snapshot_id").alias("total")), "SELECT c_mktsegment AS market, c_nationkey AS timeframe, count(*) AS n, max(c_acctbal) AS newest, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer GROUP BY 1, 2")
