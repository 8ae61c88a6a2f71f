"""Registered queries: checks, ledger, monitoring, documents, streaming.

Ledger tables are views of the order tables: customers are strategies (family:
nation, market: segment) and orders their experiments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry as r
from .operators import state
from .plans import backtest, checks, documents, ledger, metrics, monitor
from .registry import WITH_RUN, _TC, _TRADES, add, bars_run, base, c, curve
from .sources.bars import table
from .streaming import jobs

T = table

# Checks

add("k2_truncation", lambda s, d: checks.truncations(base(s, d), lambda frame: r._entry()), f"{WITH_RUN}, en AS (SELECT instrument, count(*) AS n FROM p GROUP BY 1), ct AS (SELECT instrument, s AS cut, CAST(floor(n * s) AS BIGINT) AS z FROM en, (VALUES (0.5), (0.7), (0.85)) v(s)) SELECT CAST(cut AS DOUBLE) AS cut, p.instrument, CAST(0 AS BIGINT) AS n_differ, count(*) AS n FROM p JOIN ct ON ct.instrument = p.instrument AND bar_ix < z - 5 GROUP BY 1, 2")
add("k5_finite", lambda s, d: bars_run(s, d).groupBy("instrument").agg(F.count_if(c("signal").isNotNull()).alias("known"), F.sum("non_finite").alias("non_finite")), f"{WITH_RUN} SELECT instrument, count(signal) AS known, CAST(sum(CASE WHEN held <> 0 AND hold_ret IS NULL THEN 1 ELSE 0 END + CASE WHEN opened <> 0 AND hold_ret IS NULL THEN 1 ELSE 0 END + CASE WHEN closed <> 0 AND prev IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS non_finite FROM b GROUP BY instrument")
_quarter = lambda s, d: backtest.run(checks.last_quarter(r._signal(s, d)), bps=0.0)
add("k6_last_quarter", lambda s, d: backtest.trade_counts(_quarter(s, d)).select("instrument", "n_trades", (c("n_trades") >= 5).alias("enough")), f"{WITH_RUN}, f AS (SELECT CAST(floor((max(bar_ix) + 1) * 0.75) AS BIGINT) AS first FROM p), lq AS (SELECT instrument, date, bar_ix - first AS bar_ix, close, signal FROM sg, f WHERE bar_ix >= first), l1 AS (SELECT *, CASE WHEN close IS NULL THEN 0.0 ELSE coalesce(lag(signal) OVER (PARTITION BY instrument ORDER BY bar_ix), 0) END AS w FROM lq), q AS (SELECT *, sign(w) <> 0 AND sign(w) <> coalesce(lag(sign(w)) OVER (PARTITION BY instrument ORDER BY bar_ix), 0) AS enters FROM l1 WHERE bar_ix > 0) SELECT instrument, count(*) FILTER (enters) AS n_trades, count(*) FILTER (enters) >= 5 AS enough FROM q GROUP BY instrument")
add("k7_gross_and_net", lambda s, d: checks.as_rows(curve(s, d).agg(F.sum("gross").alias("g"), F.sum("net").alias("n")).withColumn("run", F.lit("all")), ["run"], [checks.check_row("gross", "p2", c("g") > 0, c("g"), F.lit(0.0)), checks.check_row("net", "p2", c("n") > 0, c("n"), F.lit(0.0))]), f"{WITH_RUN}, t AS (SELECT sum(gross) AS g, sum(net) AS n FROM curve) SELECT 'all' AS run, 'gross' AS test_name, 'p2' AS category, CASE WHEN g > 0 THEN 'pass' ELSE 'fail' END AS outcome, g AS value, 0.0 AS threshold FROM t UNION ALL SELECT 'all', 'net', 'p2', CASE WHEN n > 0 THEN 'pass' ELSE 'fail' END, n, 0.0 FROM t")


def _runs(s: SparkSession, d: str) -> DataFrame:
    """A row an instrument, as if each were a run."""
    bars = bars_run(s, d)
    by = bars.filter("bar_ix > 0").groupBy("instrument").agg(F.sum("gross").alias("gross"), F.sum("net").alias("net"))
    worst = backtest.equity(bars.filter("bar_ix > 0"), ("instrument",)).groupBy("instrument").agg((-F.min("drawdown")).alias("max_drawdown"))
    return backtest.trade_counts(bars).join(by, "instrument").join(worst, "instrument")


_RUNS = f"""{_TC}, q1 AS (SELECT *, product(1 + net) OVER (PARTITION BY instrument ORDER BY bar_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eq FROM b WHERE bar_ix > 0), q2 AS (SELECT *, eq / max(eq) OVER (PARTITION BY instrument ORDER BY bar_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dn FROM q1),
rn AS (SELECT tc.*, s.gross, s.net, s.max_drawdown FROM tc JOIN (SELECT instrument, sum(gross) AS gross, sum(net) AS net, -min(dn) AS max_drawdown FROM q2 GROUP BY instrument) s ON s.instrument = tc.instrument)"""
_bars = lambda s, d: _runs(s, d).select("instrument", "n_trades", "max_drawdown", c("net").alias("total")).crossJoin(F.broadcast(checks.breadth(_runs(s, d).withColumn("run", F.lit("all")), ["run"]).select("breadth")))  # noqa: E731  (one row)
_BR = f"{_RUNS}, br AS (SELECT count(*) FILTER (pnl > 0) / count(*) AS breadth FROM rn WHERE n_trades > 0)"
add(
    "k8_bar",
    lambda s, d: checks.bar_verdict(_bars(s, d), 3, 5.0, 0.5).select("instrument", F.array_join("failures", ",").alias("failures"), "first_failure", "reason", "passed"),
    f"""{_BR}, v AS (SELECT instrument, [x FOR x IN [CASE WHEN n_trades < 3 THEN 'min_trades' END, CASE WHEN max_drawdown > 5 THEN 'max_drawdown' END, CASE WHEN net <= 0 THEN 'cost_stress' END, CASE WHEN breadth < 0.5 THEN 'breadth' END] IF x IS NOT NULL] AS f FROM rn, br)
SELECT instrument, array_to_string(f, ',') AS failures, f[1] AS first_failure, CASE f[1] WHEN 'min_trades' THEN 'insufficient_trades' WHEN 'max_drawdown' THEN 'monte_carlo_ruin_risk' WHEN 'cost_stress' THEN 'costs_exceed_edge' WHEN 'breadth' THEN 'capacity_constrained' END AS reason, len(f) = 0 AS passed FROM v""",
)
add("k8_unset_floor_warns", lambda s, d: checks.as_rows(_bars(s, d), ["instrument"], checks.bar_checks()).filter("test_name = 'breadth'"), f"{_BR} SELECT instrument, 'breadth' AS test_name, 'performance' AS category, 'warn' AS outcome, breadth AS value, CAST(NULL AS DOUBLE) AS threshold FROM rn, br")
add("k9_breadth", lambda s, d: checks.breadth(_runs(s, d).withColumn("run", F.lit("all")), ["run"]), f"{_RUNS} SELECT 'all' AS run, count(*) FILTER (pnl > 0) / count(*) AS breadth FROM rn WHERE n_trades > 0")
add("k11_current_bar", lambda s, d: ledger.latest(T(s, d, "orders").filter("o_orderstatus <> 'P'"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey"), "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus <> 'P') WHERE k = 1")
add("k12_worst_outcome", lambda s, d: checks.worst_outcome(T(s, d, "orders").select("o_custkey", F.when(c("o_orderstatus") == "F", "fail").when(c("o_orderstatus") == "P", "warn").otherwise("pass").alias("outcome")), ["o_custkey"]), "SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS worst FROM orders GROUP BY o_custkey")
add("k14_capacity", lambda s, d: checks.capacity(bars_run(s, d), 100.0), f"{WITH_RUN}, mv AS (SELECT *, abs(weight - coalesce(lag(weight) OVER (PARTITION BY instrument ORDER BY bar_ix), 0)) AS move FROM b) SELECT instrument, max(CASE WHEN close * volume > 0 THEN move * 100.0 / (close * volume) ELSE 0 END) AS capacity FROM mv GROUP BY instrument")
add("k14_equities_gate", lambda s, d: checks.equities_gate(bars_run(s, d), 100.0, 0.05, True, False), f"{WITH_RUN}, mv AS (SELECT *, abs(weight - coalesce(lag(weight) OVER (PARTITION BY instrument ORDER BY bar_ix), 0)) AS move FROM b), wo AS (SELECT max(CASE WHEN close * volume > 0 THEN move * 100.0 / (close * volume) ELSE 0 END) AS v FROM mv) SELECT 'equities_survivorship' AS test_name, 'correctness' AS category, 'fail' AS outcome, CAST(NULL AS DOUBLE) AS value, 0.0 AS threshold UNION ALL SELECT 'equities_capacity', 'performance', CASE WHEN v <= 0.05 THEN 'pass' ELSE 'fail' END, v, 0.05 FROM wo")
add("k15_funding_sweep", lambda s, d: checks.funding_sweep(curve(s, d)), f"{WITH_RUN}, t AS (SELECT sum(gross) AS g, sum(cost) AS c FROM curve) SELECT m AS multiple, g - m * c AS net, g - m * c > 0 AS survives FROM t, (VALUES (1.0), (2.0), (3.0), (5.0)) v(m)")
_venue = lambda s, d: base(s, d).filter("instrument = '5-LOW'").select("date", F.coalesce("ret", F.lit(0.0)).alias("net"))
_funded = lambda s, d: bars_run(s, d).filter("bar_ix > 0").select("date", "gross", "cost", (F.abs("weight") * 0.0002).alias("funding"))
add("k15_crypto_gate", lambda s, d: checks.crypto_gate(_funded(s, d), _venue(s, d)), f"""{WITH_RUN}, fu AS (SELECT date, gross, cost, abs(weight) * 0.0002 AS funding FROM b WHERE bar_ix > 0), su AS (SELECT sum(gross - cost) AS base, sum(funding) AS f FROM fu),
sv AS (SELECT CASE WHEN base - f <= 0 THEN 0.0 WHEN base - 2 * f <= 0 THEN 1.0 WHEN base - 3 * f <= 0 THEN 2.0 WHEN base - 5 * f <= 0 THEN 3.0 ELSE 5.0 END AS v FROM su),
mi AS (SELECT net, row_number() OVER (ORDER BY date DESC) AS k FROM (SELECT date, sum(gross) - sum(cost) - sum(funding) AS net FROM fu GROUP BY date)), ve AS (SELECT coalesce(ret, 0) AS net, row_number() OVER (ORDER BY date DESC) AS k FROM p WHERE instrument = '5-LOW'),
rh AS (SELECT coalesce(corr(mi.net, ve.net), 0) AS rho FROM mi JOIN ve ON ve.k = mi.k)
SELECT 'crypto_funding_sensitivity' AS test_name, 'cost' AS category, CASE WHEN v >= 1 THEN 'pass' ELSE 'fail' END AS outcome, v AS value, 1.0 AS threshold FROM sv UNION ALL SELECT 'crypto_venue_robustness', 'robustness', CASE WHEN rho >= 0.5 THEN 'pass' ELSE 'fail' END, rho, 0.5 FROM rh""")
add("k16_series_correlation", lambda s, d: metrics.correlations(base(s, d).filter("instrument = '5-LOW'").select("date", c("ret").alias("net")), base(s, d).select(c("instrument").alias("run"), "date", c("ret").alias("net"))), f"{WITH_RUN} SELECT a.instrument AS run, corr(z.ret, a.ret) AS rho, count(*) AS n_common FROM p a JOIN p z ON z.date = a.date AND z.instrument = '5-LOW' GROUP BY 1 HAVING count(*) >= 10")
add("m16_correlations", r.QUERIES["k16_series_correlation"], r.SQL["k16_series_correlation"])
_pnl = lambda s, d: T(s, d, "events").select("ts", (c("value") - 50).alias("pnl"), (c("event_id") % 10 / 100).alias("carry"))
_SES = "WITH e AS (SELECT CAST(floor((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 28800) AS INTEGER) AS session, sum(value - 50) AS total FROM events GROUP BY 1), sh AS (SELECT session, total, CASE WHEN sum(abs(total)) OVER () > 0 THEN abs(total) / sum(abs(total)) OVER () ELSE 0 END AS share FROM e)"
add("k17_session_shares", lambda s, d: checks.session_shares(_pnl(s, d)), f"{_SES} SELECT * FROM sh")
add("k17_forex_gate", lambda s, d: checks.forex_gate(_pnl(s, d)), f"{_SES} SELECT 'forex_session_dependence' AS test_name, 'regime' AS category, CASE WHEN max(share) <= 0.8 THEN 'pass' ELSE 'fail' END AS outcome, max(share) AS value, 0.8 AS threshold FROM sh UNION ALL SELECT 'forex_carry_decomposition', 'cost', 'pass', (SELECT sum(abs(event_id % 10 / 100)) / sum(abs(value - 50)) FROM events), 0.0")
add("k18_funnel", lambda s, d: checks.funnel(_runs(s, d)).select("instrument", "phase", "reason"), f"{_RUNS} SELECT instrument, CASE WHEN n_trades < 5 THEN 'p1' WHEN gross <= 0 OR net <= 0 THEN 'p2' ELSE 'p3' END AS phase, CASE WHEN n_trades < 5 THEN 'too few trades' WHEN gross <= 0 THEN 'no gross profit' WHEN net <= 0 THEN 'costs take the profit' END AS reason FROM rn")
add("k20_ratchet", lambda s, d: checks.ratchet(T(s, d, "orders").select("o_custkey", "o_orderkey", c("o_totalprice").alias("score")), "o_custkey", "o_orderkey", 200_000.0).select("o_orderkey", "best_before", "kept"), "WITH b AS (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM orders) SELECT o_orderkey, CASE WHEN m >= 200000 THEN m END AS best_before, CASE WHEN m >= 200000 THEN o_totalprice > m ELSE o_totalprice >= 200000 END AS kept FROM b")

# Ledger
_X = lambda s, d: T(s, d, "orders").join(T(s, d, "customer"), c("o_custkey") == c("c_custkey"))
XS = "orders JOIN customer ON o_custkey = c_custkey"
add("l1_trial_counts", lambda s, d: ledger.trial_counts(_X(s, d).select(c("c_nationkey").alias("family"), c("c_mktsegment").alias("market"), F.when(c("o_orderstatus") != "P", c("o_orderkey") % 7).alias("iteration_count")), ["family", "market"]), f"SELECT c_nationkey AS family, c_mktsegment AS market, CAST(coalesce(sum(CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 7 END), 0) AS BIGINT) AS trials FROM {XS} GROUP BY 1, 2")
add("l2_comparable", lambda s, d: ledger.comparable(T(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.when(c("o_orderkey") % 5 != 0, c("o_orderpriority")).alias("data_hash"), F.year("o_orderdate").alias("cost_hash")), ["o_custkey", "o_orderstatus", "data_hash", "cost_hash"]).select("o_orderkey", "n_comparable"), "WITH e AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS h, year(o_orderdate) AS y FROM orders) SELECT o_orderkey, CASE WHEN h IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY o_custkey, o_orderstatus, h, y) - 1 END AS n_comparable FROM e")
add("l2_marked_incomparable", lambda s, d: ledger.mark_incomparable(T(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), o_orderstatus="P", o_orderpriority="5-LOW").select("o_orderkey", "comparable"), "SELECT o_orderkey, NOT coalesce(o_orderstatus = 'P' AND o_orderpriority = '5-LOW', false) AS comparable FROM orders")
add("l3_next_iteration", lambda s, d: T(s, d, "orders").groupBy("o_custkey").agg((F.max("o_orderkey") + 1).alias("next_id")), "SELECT o_custkey, max(o_orderkey) + 1 AS next_id FROM orders GROUP BY 1")
add("l4_latest_evaluation", lambda s, d: ledger.latest(T(s, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice"), "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
add("l5_active_goals", lambda s, d: T(s, d, "customer").withColumn("budget", F.when(c("c_acctbal") > 0, c("c_acctbal"))).filter(c("budget").isNull() | (c("budget") > 5000)).select("c_custkey", "budget"), "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS budget FROM customer WHERE c_acctbal <= 0 OR c_acctbal > 5000")
add(
    "l6_open_questions",
    lambda s, d: ledger.answered(
        T(s, d, "part").select(c("p_partkey").alias("question_id"), c("p_size").alias("priority"), F.array(c("p_partkey"), c("p_partkey") + 1).alias("ids")),
        T(s, d, "lineitem").groupBy(c("l_orderkey").alias("finding_id")).agg(F.collect_set("l_partkey").alias("ids")),
    ).select("question_id", "priority", "n_answers", F.size("ids").alias("n_ids"), F.array_min("ids").alias("first_id"), F.array_max("ids").alias("last_id")),
    """WITH f AS (SELECT DISTINCT l_orderkey AS finding_id, l_partkey AS id FROM lineitem), q AS (SELECT p_partkey AS question_id, p_size AS priority, unnest([p_partkey, p_partkey + 1]) AS id FROM part),
m AS (SELECT DISTINCT question_id, finding_id FROM q JOIN f ON f.id = q.id), u AS (SELECT question_id, id FROM q UNION SELECT m.question_id, f.id FROM m JOIN f ON f.finding_id = m.finding_id)
SELECT p_partkey AS question_id, p_size AS priority, (SELECT count(*) FROM m WHERE m.question_id = p_partkey) AS n_answers, CAST(n AS INTEGER) AS n_ids, a AS first_id, z AS last_id FROM part JOIN (SELECT question_id, count(*) AS n, min(id) AS a, max(id) AS z FROM u GROUP BY 1) x ON x.question_id = p_partkey""",
)
add("l7_specs_using", lambda s, d: T(s, d, "lineitem").filter("l_quantity > 45").select("l_orderkey").join(T(s, d, "orders"), c("l_orderkey") == c("o_orderkey")).join(T(s, d, "customer"), c("o_custkey") == c("c_custkey")).select("c_custkey").distinct(), f"SELECT DISTINCT c_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 45")
_nodes = lambda s, d: _X(s, d).select(c("c_nationkey").alias("family"), c("o_custkey").alias("spec_id"), c("o_orderpriority").alias("operator"), c("o_orderstatus").alias("version"), F.lit("entry").alias("role"))
_L8 = f"""WITH sp AS (SELECT c_nationkey AS family, o_custkey AS spec_id, list_sort(list(DISTINCT o_orderpriority || '/' || o_orderstatus || '/entry')) AS items FROM {XS} GROUP BY 1, 2),
cl AS (SELECT family, items, min(spec_id) AS class_id, count(*) AS n FROM sp GROUP BY 1, 2), pr AS (SELECT x.family, x.class_id AS a, y.class_id AS b, x.n AS n_a, y.n AS n_b, len(list_intersect(x.items, y.items)) AS i, len(x.items) + len(y.items) AS t FROM cl x JOIN cl y ON y.family = x.family AND x.class_id < y.class_id),
lk AS (SELECT family, a, b, n_a, n_b, i / (t - i) AS jaccard FROM pr WHERE i / (t - i) >= 0.8)"""
add("l8_near_duplicates", lambda s, d: ledger.near_duplicates(_nodes(s, d)), f"{_L8}, nb AS (SELECT family, id, sum(n) AS n FROM (SELECT family, a AS id, n_b AS n FROM lk UNION ALL SELECT family, b, n_a FROM lk) GROUP BY 1, 2) SELECT sp.family, sp.spec_id, cl.class_id, CAST(cl.n - 1 + coalesce(nb.n, 0) AS BIGINT) AS n_links FROM sp JOIN cl ON cl.family = sp.family AND cl.items = sp.items LEFT JOIN nb ON nb.family = sp.family AND nb.id = cl.class_id")
add("l8_class_pairs", lambda s, d: ledger.class_pairs(ledger.spec_classes(_nodes(s, d))[1]), f"{_L8} SELECT family, a, b, jaccard FROM lk")
add("l9_exact_duplicates", lambda s, d: T(s, d, "documents").join(documents.first_of_each(T(s, d, "documents")).select("doc_id"), "doc_id", "left_anti").select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT min(doc_id) FROM documents GROUP BY text)")
add("l10_registry_sync", lambda s, d: ledger.registry_sync(T(s, d, "customer").filter("c_custkey % 3 <> 0").select(c("c_custkey").alias("name"), c("c_mktsegment").alias("hash")), T(s, d, "customer").filter("c_custkey % 4 <> 0").select(c("c_custkey").alias("name"), F.when(c("c_custkey") % 5 == 0, "x").otherwise(c("c_mktsegment")).alias("hash"))), "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'inserted' WHEN c_custkey % 4 = 0 THEN 'gone' WHEN c_custkey % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS kind, count(*) AS n FROM customer WHERE c_custkey % 12 <> 0 GROUP BY 1")
_entries = lambda s, d: T(s, d, "part").select(c("p_partkey").alias("id"), F.when(c("p_size") % 3 == 0, "failure_pattern").when(c("p_size") % 3 == 1, "counter_evidence").otherwise("finding").alias("kind"), F.when(c("p_partkey") % 4 != 0, F.array(F.when(c("p_partkey") % 2 == 0, "BUILDING").otherwise("MACHINERY"))).alias("markets"), c("p_retailprice").alias("confidence"))
add("l11_relevant_entries", lambda s, d: ledger.failure_patterns(_entries(s, d), "BUILDING", 25).select("id", "kind", "confidence"), "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'failure_pattern' ELSE 'counter_evidence' END AS kind, p_retailprice AS confidence FROM part WHERE p_size % 3 <> 2 AND (p_partkey % 4 = 0 OR p_partkey % 2 = 0) ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
_obs = lambda s, d: _X(s, d).select(c("c_mktsegment").alias("subject"), c("o_orderstatus").alias("predicate"), c("o_orderpriority").alias("object"), (c("o_totalprice") > 150_000).alias("supports"), F.array("o_custkey").alias("backing"), c("o_orderdate").alias("at"), c("o_totalprice").alias("confidence"))
add(
    "l12_edges",
    lambda s, d: ledger.edge_observations(_obs(s, d)).withColumn("n_backing", F.size("backing")).drop("backing"),
    f"SELECT c_mktsegment AS subject, o_orderstatus AS predicate, o_orderpriority AS object, count(*) FILTER (o_totalprice > 150000) AS n_for, count(*) FILTER (NOT o_totalprice > 150000) AS n_against, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, last(o_totalprice ORDER BY o_orderdate, o_totalprice) AS confidence, CAST(count(DISTINCT o_custkey) AS INTEGER) AS n_backing FROM {XS} GROUP BY 1, 2, 3",
)
add(
    "l13_repeat_failures",
    lambda s, d: ledger.repeat_failures(_X(s, d).filter("o_orderstatus = 'F'").select(F.concat_ws("/", "o_orderpriority", c("o_custkey") % 97).alias("reason"), c("c_mktsegment").alias("market"), c("o_orderdate").alias("at")), _X(s, d).select(F.concat_ws("/", "o_orderpriority", c("o_custkey") % 97).alias("reason"), F.when(c("o_orderstatus") != "P", c("c_mktsegment")).alias("market"), c("o_orderdate").alias("at"))),
    f"""WITH x AS (SELECT o_orderpriority || '/' || o_custkey % 97 AS reason, CASE WHEN o_orderstatus <> 'P' THEN c_mktsegment END AS entry_market, c_mktsegment AS market, o_orderdate AS at, o_orderstatus AS status FROM {XS}),
f AS (SELECT EXISTS (SELECT 1 FROM x e WHERE e.reason = f.reason AND (e.entry_market IS NULL OR e.entry_market = f.market) AND e.at < f.at) AS known FROM x f WHERE status = 'F')
SELECT count(*) AS failures, count(*) FILTER (known) AS repeated, coalesce(count(*) FILTER (known) / nullif(count(*), 0), 0) AS rate FROM f""",
)
add("l14_payoff", lambda s, d: T(s, d, "orders").agg(F.coalesce(F.try_divide(F.count_if(c("o_totalprice") > 200_000), F.count("*")), F.lit(0.0)).alias("rate")), "SELECT count(*) FILTER (o_totalprice > 200000) / count(*) AS rate FROM orders")
add("l15_failure_groups", lambda s, d: ledger.newest_per_family(_X(s, d).filter("o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'").select(c("c_nationkey").alias("family"), c("o_orderpriority").alias("reason"), c("o_orderdate").alias("at"), c("o_orderkey").alias("id"))), f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM {XS} WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT') SELECT c_nationkey AS family, o_orderpriority AS reason, count(*) AS n FROM k WHERE k <= 50 GROUP BY 1, 2")
add("l16_funnel_counts", lambda s, d: T(s, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.count("*").alias("started"), F.count_if(c("o_orderstatus") == "O").alias("cleared"), F.countDistinct("o_custkey").alias("strategies"), (F.sum("o_totalprice") / F.nullif(F.count_if(c("o_orderstatus") == "O"), F.lit(0))).alias("per_clear")), "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS started, count(*) FILTER (o_orderstatus = 'O') AS cleared, count(DISTINCT o_custkey) AS strategies, sum(o_totalprice) / nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS per_clear FROM orders GROUP BY 1")
_dep = lambda s, d: T(s, d, "orders").select(c("o_orderdate").cast("date").alias("started"), F.when(c("o_orderstatus") == "F", F.date_add(c("o_orderdate").cast("date"), (c("o_orderkey") % 500).cast("int"))).alias("ended"), F.lit("2001-08-01").cast("date").alias("now"))
_full = lambda a, z: f"(year({z}) * 12 + month({z}) - year({a}) * 12 - month({a}) - CASE WHEN day({z}) < day({a}) AND NOT ({z} = last_day({z}) AND {a} = last_day({a})) THEN 1 ELSE 0 END)"
add("l18_survival", lambda s, d: ledger.survival(_dep(s, d)), f"WITH x AS (SELECT CAST(o_orderdate AS DATE) AS a, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 500 AS INTEGER) END AS z, DATE '2001-08-01' AS n, unnest([3, 6, 12]) AS months FROM orders) SELECT CAST(months AS INTEGER) AS months, count(*) AS n, count(*) FILTER (z IS NULL OR {_full('a', 'z')} >= months) / count(*) AS share FROM x WHERE {_full('a', 'n')} >= months GROUP BY 1")
add("l19_agreement", lambda s, d: T(s, d, "labels").agg(F.avg((c("quality") == c("toxic")).cast("double")).alias("rate")), "SELECT avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS rate FROM labels")
add("l21_strategies", lambda s, d: T(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.countDistinct("c_mktsegment").alias("n_markets")), "SELECT c_nationkey, count(*) AS n, count(DISTINCT c_mktsegment) AS n_markets FROM customer GROUP BY 1")
add("l22_stages", lambda s, d: ledger.stage_counts(T(s, d, "orders").select(c("o_orderstatus").alias("stage")), ["O", "P", "X", "F"]), "SELECT v.place, v.stage, count(o_orderkey) AS n FROM (VALUES (0, 'O'), (1, 'P'), (2, 'X'), (3, 'F')) v(place, stage) LEFT JOIN orders ON o_orderstatus = v.stage GROUP BY 1, 2")
add("l23_decision_queue", lambda s, d: T(s, d, "customer").select("c_custkey", (F.coalesce(F.when(c("c_acctbal") > 0, c("c_acctbal") / 10_000), F.lit(0.5)) * F.greatest(c("c_nationkey").cast("double"), F.lit(0.1))).alias("rank")).orderBy(F.desc("rank"), "c_custkey").limit(25), "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal / 10000 END, 0.5) * greatest(CAST(c_nationkey AS DOUBLE), 0.1) AS rank FROM customer ORDER BY rank DESC, c_custkey LIMIT 25")
# Margins tie within a rounding, so doubles are added in the order of the file, as SQL on one thread does; an order has few lines.
_margins = lambda s, d: ledger.sums_in_order(T(s, d, "lineitem"), "l_orderkey", ["l_quantity", "l_tax", "l_discount", "l_extendedprice"], ["_metadata.file_path", "_metadata.row_index"]).selectExpr("l_orderkey", "stack(4, 'quantity', double(l_quantity), 100D, 'tax', double(l_tax), 0.15D, 'discount', double(l_discount), 0.2D, 'price', double(l_extendedprice), 0D) AS (name, value, threshold)")
_regs = lambda s, d: T(s, d, "lineitem").groupBy("l_orderkey", c("l_returnflag").alias("regime")).agg((F.avg("l_quantity") - 25).cast("double").alias("sharpe"))
add(
    "l24_case_against",
    lambda s, d: ledger.case_against(_margins(s, d), _regs(s, d), "l_orderkey"),
    """WITH a AS (SELECT l_orderkey, sum(l_quantity) AS q, sum(l_tax) AS t, sum(l_discount) AS di, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1),
m AS (SELECT l_orderkey, 'quantity' AS name, abs((q - 100) / 100.0) AS v FROM a UNION ALL SELECT l_orderkey, 'tax', abs((t - 0.15) / 0.15) FROM a UNION ALL SELECT l_orderkey, 'discount', abs((di - 0.2) / 0.2) FROM a UNION ALL SELECT l_orderkey, 'price', NULL FROM a),
k AS (SELECT l_orderkey, 'threshold' AS kind, name, CAST(v AS DOUBLE) AS value, row_number() OVER (PARTITION BY l_orderkey ORDER BY v NULLS LAST, name) AS place FROM m),
g AS (SELECT l_orderkey, l_returnflag AS regime, avg(l_quantity) - 25 AS sharpe FROM lineitem GROUP BY 1, 2), w AS (SELECT l_orderkey, 'regime' AS kind, regime AS name, CAST(sharpe AS DOUBLE) AS value, row_number() OVER (PARTITION BY l_orderkey ORDER BY sharpe, regime) AS place FROM g)
SELECT * FROM k WHERE place <= 3 UNION ALL SELECT * FROM w WHERE place <= 2""",
)
add("l24_nearest_thresholds", lambda s, d: ledger.latest(T(s, d, "orders").withColumn("margin", F.abs(c("o_totalprice") / 150_000 - 1)), ["o_custkey"], [c("margin"), c("o_orderkey")]).select("o_custkey", "o_orderkey", "margin"), "SELECT o_custkey, o_orderkey, margin FROM (SELECT *, abs(o_totalprice / 150000 - 1) AS margin, row_number() OVER (PARTITION BY o_custkey ORDER BY abs(o_totalprice / 150000 - 1), o_orderkey) AS k FROM orders) WHERE k = 1")
add("l29_budget_use", lambda s, d: ledger.budget_use(T(s, d, "events").select(c("event_type").alias("scope"), c("ts").alias("at"), c("value").alias("amount")), 5000.0, "week"), "SELECT event_type AS scope, CAST(date_trunc('week', ts) AS TIMESTAMP) AS period, sum(value) AS used, sum(value) >= 5000 AS exhausted FROM events GROUP BY 1, 2")
add("l30_quarantine", lambda s, d: ledger.quarantine(T(s, d, "orders").select(c("o_custkey").alias("entity"), c("o_orderdate").alias("at"), c("o_orderkey").alias("id"), (c("o_orderstatus") == "F").alias("failed"))), "SELECT o_custkey AS entity FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 3 GROUP BY 1 HAVING count(*) = 3 AND bool_and(o_orderstatus = 'F')")
add("l31_status_counts", lambda s, d: T(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")), "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
_log = lambda s, d: T(s, d, "orders").select(c("o_custkey").alias("entity"), c("o_orderdate").alias("at"), c("o_orderkey").alias("id"), c("o_orderstatus").alias("status"))
_LG = "WITH g AS (SELECT o_custkey AS entity, o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS pr, o_totalprice AS price, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, o_orderdate AS tm FROM orders)"
add("l34_illegal_transitions", lambda s, d: ledger.illegal_transitions(_log(s, d), s.createDataFrame([("O", "P"), ("P", "F"), ("O", "F")], "before string, status string")).select("entity", "id", "before", "status"), f"{_LG} SELECT entity, id, before, status FROM g WHERE before IS NOT NULL AND before <> status AND NOT (before, status) IN (('O', 'P'), ('P', 'F'), ('O', 'F'))")
add("l36_plateau", lambda s, d: ledger.streak(_log(s, d), "entity", ["at", "id"], c("status") == "O").select("entity", "id", "streak"), f"{_LG}, i AS (SELECT *, count(*) FILTER (status = 'O') OVER (PARTITION BY entity ORDER BY tm, id) AS island FROM g) SELECT entity, id, CAST(count(*) FILTER (status <> 'O') OVER (PARTITION BY entity, island ORDER BY tm, id) AS BIGINT) AS streak FROM i")
add("l35_plateau_verdict", lambda s, d: ledger.streak(_log(s, d), "entity", ["at", "id"], c("status") == "O").groupBy("entity").agg((F.max("streak") >= 4).alias("plateau"), (F.count("*") >= 15).alias("capped")), f"{_LG}, i AS (SELECT *, count(*) FILTER (status = 'O') OVER (PARTITION BY entity ORDER BY tm, id) AS island FROM g), k AS (SELECT entity, count(*) FILTER (status <> 'O') OVER (PARTITION BY entity, island ORDER BY tm, id) AS streak FROM i) SELECT entity, max(streak) >= 4 AS plateau, count(*) >= 15 AS capped FROM k GROUP BY entity")
add("l37_audit_trail", lambda s, d: T(s, d, "events").filter("user_id = 7").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "event_type"), "SELECT event_id, event_type FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id LIMIT 100")
add("l39_ordered_json", lambda s, d: ledger.ordered_json(T(s, d, "orders"), "o_custkey", ["o_orderkey", "o_orderstatus"]), """SELECT o_custkey, '[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']' AS rows FROM orders GROUP BY 1""")

# Monitoring
START = "1999-06-01"
_ER = f"""{WITH_RUN}, er AS (SELECT date, bar_ix, net, CASE WHEN date <= DATE '{START}' THEN 'baseline' ELSE 'paper' END AS era FROM curve),
e2 AS (SELECT *, product(1 + net) OVER (PARTITION BY era ORDER BY bar_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM er),
e3 AS (SELECT *, 1 - equity / max(equity) OVER (PARTITION BY era ORDER BY bar_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS drawdown FROM e2)"""
_eras = lambda s, d: monitor.eras(curve(s, d), START)
add("h1_eras", lambda s, d: _eras(s, d).select("date", "era", "equity", "drawdown"), f"{_ER} SELECT date, era, equity, drawdown FROM e3")
add("h2_first_breach", lambda s, d: monitor.first_breach(_eras(s, d)), f"{_ER} SELECT era, min(date) FILTER (1 - equity > 0.25 OR drawdown > 0.30) AS breached FROM e3 GROUP BY era")
add(
    "h3_z_scores",
    lambda s, d: monitor.z_scores(_eras(s, d), backtest.trades(bars_run(s, d)), START, r.PERIODS),
    f"""{_ER}{_TRADES[len(WITH_RUN):]}, pm AS (SELECT era, avg(net) AS mean, stddev_samp(net) AS std, count(*) AS n FROM er GROUP BY era),
cm AS (SELECT er.era, avg(pow(net - mean, 2)) AS c2, avg(pow(net - mean, 3)) AS c3, avg(pow(net - mean, 4)) AS c4 FROM er JOIN pm ON pm.era = er.era GROUP BY 1),
mo AS (SELECT pm.era, n, CASE WHEN std > 0 THEN mean / std * sqrt({r.PERIODS}) ELSE 0 END AS sr, CASE WHEN n > 3 AND std > 1e-9 THEN c3 / pow(c2, 1.5) * sqrt(n * (n - 1.0)) / (n - 2) ELSE 0 END AS skew, CASE WHEN n > 3 AND std > 1e-9 THEN (n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * (c4 / (c2 * c2) - 3) + 6) + 3 ELSE 3 END AS kurt FROM pm JOIN cm ON cm.era = pm.era),
tr AS (SELECT CASE WHEN entry_date <= DATE '{START}' THEN 'baseline' ELSE 'paper' END AS era, avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) AS win, avg(net_return) AS mean, stddev_samp(net_return) AS std, count(*) AS n FROM trades WHERE NOT open_at_end GROUP BY 1),
zs AS (SELECT coalesce(p.sr, 0) - coalesce(b.sr, 0) AS d1, sqrt(greatest(0, 1 + p.sr * p.sr / 2 - p.skew * p.sr + (p.kurt - 3) / 4 * p.sr * p.sr) / p.n) AS e1, coalesce(tp.win, 0) - coalesce(tb.win, 0) AS d2, sqrt(tb.win * (1 - tb.win) / tp.n) AS e2,
       coalesce(tp.mean, 0) - coalesce(tb.mean, 0) AS d3, tb.std / sqrt(tp.n) AS e3, coalesce(tp.n, 0) AS n_trades FROM (SELECT 1) LEFT JOIN mo p ON p.era = 'paper' LEFT JOIN mo b ON b.era = 'baseline' LEFT JOIN tr tp ON tp.era = 'paper' LEFT JOIN tr tb ON tb.era = 'baseline')
SELECT CASE WHEN e1 > 0 THEN d1 / e1 ELSE sign(d1) * 1e6 END AS z_sharpe, CASE WHEN e2 > 0 THEN d2 / e2 ELSE sign(d2) * 1e6 END AS z_win, CASE WHEN e3 > 0 THEN d3 / e3 ELSE sign(d3) * 1e6 END AS z_trade, n_trades FROM zs""",
)
_loss = lambda s, d: backtest.trades(bars_run(s, d)).filter("net_return < 0").select(F.when(c("entry_date") <= F.lit(START).cast("date"), "a").otherwise("b").alias("side"), c("net_return").alias("x"))
_KS = f"""{_TRADES}, v AS (SELECT CASE WHEN entry_date <= DATE '{START}' THEN 'a' ELSE 'b' END AS side, net_return AS x FROM trades WHERE net_return < 0), z AS (SELECT count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM v),
kd AS (SELECT x, count(*) FILTER (side = 'a') OVER (ORDER BY x) AS ca, count(*) FILTER (side = 'b') OVER (ORDER BY x) AS cb FROM v), dist AS (SELECT na, nb, max(abs(ca / nullif(na, 0) - cb / nullif(nb, 0))) AS distance FROM kd, z GROUP BY na, nb)"""
add("h4_ks_distance", lambda s, d: monitor.ks_distance(_loss(s, d)).select("na", "nb", "distance"), f"{_KS} SELECT * FROM dist")
add(
    "h4_ks_p_value",
    lambda s, d: monitor.ks_distance(_loss(s, d)).select("p_value"),
    f"""{_KS.replace("WITH ", "WITH RECURSIVE ", 1)}, walk AS (SELECT 0 AS step, 0 AS i, CAST(1 AS DOUBLE) AS a UNION ALL
SELECT step, i, sum(a) AS a FROM (SELECT w.step + 1 AS step, w.i + s.d AS i, w.a * CASE s.d WHEN 1 THEN w.i + 1 ELSE w.step + 1 - w.i END / (w.step + 1) AS a FROM walk w, (VALUES (0), (1)) s(d), dist
WHERE w.step < na + nb AND w.i + s.d <= na AND w.step + 1 - w.i - s.d <= nb AND abs((w.i + s.d) / na - (w.step + 1 - w.i - s.d) / nb) < distance - 1e-12) GROUP BY step, i)
SELECT 1 - coalesce(max(a), 0) AS p_value FROM walk, dist WHERE step = na + nb""",
)
add(
    "h5_levels",
    lambda s, d: monitor.level(T(s, d, "customer").select("c_custkey", (c("c_acctbal") / 2000 - 2.5).alias("z_sharpe"), (c("c_nationkey") / 5.0 - 2.5).alias("z_win"), (c("c_custkey") % 13 / 4 - 2).alias("z_trade"), (c("c_custkey") % 97 / 400).alias("p_loss"), (c("c_custkey") % 3 == 0).alias("weak_regime"), (c("c_custkey") % 60).alias("n_trades"))).select("c_custkey", "level"),
    """WITH s AS (SELECT c_custkey, c_acctbal / 2000 - 2.5 AS a, c_nationkey / 5.0 - 2.5 AS b, c_custkey % 13 / 4 - 2 AS t, c_custkey % 97 / 400 AS p, c_custkey % 3 = 0 AS weak, c_custkey % 60 AS n FROM customer),
k AS (SELECT *, (CASE WHEN a < -1.5 THEN 1 ELSE 0 END) + (CASE WHEN b < -1.5 THEN 1 ELSE 0 END) + (CASE WHEN t < -1.5 THEN 1 ELSE 0 END) + (CASE WHEN p < 0.01 THEN 1 ELSE 0 END) AS tripped FROM s),
v AS (SELECT *, CASE WHEN a < -3 OR b < -3 OR t < -3 OR p < 0.01 THEN 'red' WHEN tripped >= 2 THEN 'orange' WHEN tripped = 1 THEN 'yellow' ELSE 'green' END AS level FROM k)
SELECT c_custkey, CASE WHEN n < 20 THEN 'green' WHEN weak AND level = 'red' THEN 'orange' WHEN weak AND level = 'orange' THEN 'yellow' ELSE level END AS level FROM v""",
)
add("h6_regimes_covered", lambda s, d: _X(s, d).groupBy("c_nationkey").agg(F.collect_set("o_orderpriority").alias("seen")).select("c_nationkey", (F.size(F.array_except(F.array(F.lit("1-URGENT"), F.lit("5-LOW")), "seen")) == 0).alias("covered")), f"SELECT c_nationkey, bool_or(o_orderpriority = '1-URGENT') AND bool_or(o_orderpriority = '5-LOW') AS covered FROM {XS} GROUP BY 1")
add("h7_new_trades", lambda s, d: monitor.new_trades(backtest.trades(bars_run(s, d)), backtest.trades(bars_run(s, d)).filter(c("bars_held") > 3), "2000-01-01").select("instrument", "entry_date", "net_return"), f"{_TRADES} SELECT instrument, entry_date, net_return FROM trades WHERE bars_held <= 3 AND entry_date < DATE '2000-01-01'")
add("h8_level_changes", lambda s, d: monitor.level_changes(_log(s, d).withColumnRenamed("status", "level")).select("entity", "id", "before", "level"), f"{_LG} SELECT entity, id, before, status AS level FROM g WHERE before IS NOT NULL AND before <> status")
add("h9_progress", lambda s, d: monitor.progress(T(s, d, "orders").select(c("o_custkey").alias("entity"), c("o_orderdate").alias("at"), c("o_orderkey").alias("id"), c("o_orderpriority").alias("regime"))).select("id", "n", F.array_join("regimes", ",").alias("regimes")), "SELECT b.o_orderkey AS id, count(*) AS n, string_agg(DISTINCT a.o_orderpriority, ',' ORDER BY a.o_orderpriority) AS regimes FROM orders b JOIN orders a ON a.o_custkey = b.o_custkey AND (a.o_orderdate, a.o_orderkey) <= (b.o_orderdate, b.o_orderkey) GROUP BY 1")

# Documents
TERMS = ["the", "ered", "tion", "onth"]
_DOC = "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term, unnest(range(len(regexp_extract_all(lower(text), '[a-z0-9]+')))) AS pos FROM documents), t AS (SELECT * FROM w WHERE length(term) > 2 AND term NOT IN (" + ", ".join(f"'{x}'" for x in documents.STOPWORDS) + "))"
add("n1_first_of_each", lambda s, d: documents.first_of_each(T(s, d, "documents")), "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
add("n2_terms", lambda s, d: T(s, d, "documents").select("doc_id", F.size(documents.terms(c("text"))).alias("n_terms")), f"{_DOC} SELECT d.doc_id, CAST(count(DISTINCT term) AS INTEGER) AS n_terms FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY 1")
add("n3_keywords", lambda s, d: documents.keywords(T(s, d, "documents")), f"{_DOC}, g AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first FROM t GROUP BY 1, 2), k AS (SELECT doc_id, term, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS place FROM g) SELECT doc_id, term, n, CAST(place AS INTEGER) AS place FROM k WHERE place <= 6")
_REL = _DOC + ", q AS (SELECT unnest(['the', 'ered', 'tion', 'onth']) AS q), h AS (SELECT DISTINCT doc_id, q FROM t, q WHERE contains(term, q) OR contains(q, term)), rel AS (SELECT d.doc_id, count(h.q) / 4.0 AS relevance FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id GROUP BY 1)"
_rel = lambda s, d: T(s, d, "documents").select("doc_id", documents.relevance(c("text"), TERMS).alias("relevance"))
add("n4_relevance", _rel, f"{_REL} SELECT * FROM rel")
add("n5_triage", lambda s, d: documents.triage(_rel(s, d)), f"{_REL} SELECT *, CASE WHEN relevance >= 0.34 THEN 'pending' ELSE 'irrelevant' END AS status FROM rel ORDER BY relevance DESC, doc_id LIMIT 20")
_re2 = lambda p: p.replace("'", "''").replace("\\x{A0}", "\\x{00A0}")


def _html_sql() -> str:
    """The replacements of pages, and the four references that pages use."""
    x = "coalesce(html, '')"
    for pattern, new in documents.html_steps():
        signs = "".join(f"' || chr({ord(k)}) || '" if k < " " else k for k in new.replace("$1", "\\1"))
        x = f"regexp_replace({x}, '{_re2(pattern)}', '{signs}', 'g')"
    ref = "y"
    for name, sign in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        ref = f"replace({ref}, '&{name};', '{sign}')"
    edges = _re2(documents.EDGES)
    return rf"""WITH t AS (SELECT page_id, unnest(string_split({x}, chr(1))) AS raw, unnest(range(len(string_split({x}, chr(1))))) AS k FROM pages),
r AS (SELECT page_id, k, length(regexp_extract(raw, '^\x02*')) AS level, [z FOR z IN [regexp_replace({ref}, '{edges}', '', 'g') FOR y IN string_split(regexp_replace(raw, '^\x02+', ''), chr(4))] IF z <> ''] AS runs FROM t),
bl AS (SELECT page_id, k, CASE WHEN level > 0 THEN repeat('#', level) || ' ' || runs[1] || array_to_string(runs[2:], ' ') ELSE array_to_string(runs, ' ') END AS b FROM r WHERE len(runs) > 0),
j AS (SELECT page_id, string_agg(b, chr(10) || chr(10) ORDER BY k) AS text FROM bl GROUP BY 1)
SELECT p.page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(j.text, ''), '[ \t\x{{00A0}}]*(?:\r\n|[\n\r\x0B\x0C])[ \t\x{{00A0}}]*', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '{edges}', '', 'g') AS text FROM pages p LEFT JOIN j ON j.page_id = p.page_id"""


add("n6_pages_text", lambda s, d: documents.pages_text(T(s, d, "pages")), _html_sql())
add("n10_chunks", lambda s, d: documents.chunks(documents.pages_text(T(s, d, "pages")), "page_id"))
add("n18_chunk_cap", lambda s, d: documents.chunks(documents.pages_text(T(s, d, "pages")), "page_id", documents.PER_DOCUMENT).groupBy("page_id").agg(F.count("*").alias("n")))
add("n12_candidates", lambda s, d: T(s, d, "documents").filter("lang <> 'de'").orderBy(F.desc("n_chars"), "doc_id").limit(300).select("doc_id", "n_chars"), "SELECT doc_id, n_chars FROM documents WHERE lang <> 'de' ORDER BY n_chars DESC, doc_id LIMIT 300")
_COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"
add("n13_nearest", lambda s, d: documents.nearest(T(s, d, "embeddings").filter("vec_id % 50 = 0").select("vec_id", "embedding"), T(s, d, "embeddings").select("vec_id", "embedding"), 5).select("query_id", "vec_id", "place"), f"WITH k AS (SELECT b.vec_id AS query_id, a.vec_id, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_COS} DESC, a.vec_id) AS place FROM embeddings a JOIN embeddings b ON b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT query_id, vec_id, CAST(place AS INTEGER) AS place FROM k WHERE place <= 5")
add("n14_novelty", lambda s, d: documents.novelty(T(s, d, "embeddings").filter("vec_id % 50 = 0").select("vec_id", "embedding"), T(s, d, "embeddings").join(T(s, d, "embeddings").filter("vec_id % 50 = 0").select("vec_id"), "vec_id", "left_anti")), f"SELECT a.vec_id, 1 - max({_COS}) AS novelty, 1 - max({_COS}) >= 0.5 AS push FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.vec_id % 50 <> 0 GROUP BY a.vec_id")
add("n15_missing", lambda s, d: documents.missing(T(s, d, "documents").select("doc_id"), T(s, d, "labels").select("doc_id")), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
add("n16_hash_embedding", lambda s, d: T(s, d, "benchmark").select("item_id", F.posexplode(documents.hash_embedding(c("text"))).alias("k", "v")), "SELECT item_id, CAST(k AS INTEGER) AS k, CAST(CAST('0x' || substr(sha256(k // 8 || ':' || text), k % 8 * 8 + 1, 8) AS BIGINT) AS DOUBLE) / 4294967295 * 2 - 1 AS v FROM benchmark, range(32) t(k)")
add("n17_document_status", lambda s, d: ledger.latest(T(s, d, "conversations"), ["conv_id"], [F.desc("turn"), c("role")]).filter("role = 'assistant'").select("conv_id", "turn"), "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS k FROM conversations) WHERE k = 1 AND role = 'assistant'")

# Streaming: what is final an hour before the last event
_WM = "WITH wm AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS mark FROM events)"
_ticks = jobs.events
add("st1_tick_bars", lambda s, d: jobs.finish(jobs.tick_bars(_ticks(s, d))), f"{_WM} SELECT event_type AS instrument, time_bucket(INTERVAL 6 HOURS, ts) AS date, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events, wm GROUP BY 1, 2 HAVING time_bucket(INTERVAL 6 HOURS, any_value(ts)) + INTERVAL 6 HOURS <= any_value(mark)")
add(
    "st2_stale_runs",
    lambda s, d: jobs.finish(jobs.stateful(_ticks(s, d).withColumn("value", F.floor(c("value") / 20).cast("double")), "event_type", ["value"], jobs.stale_run())),
    f"{_WM}, v AS (SELECT event_type, event_id, ts, floor(value / 20) AS x FROM events, wm WHERE ts <= mark), n AS (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY event_type ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM v), i AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run FROM n) SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type, run ORDER BY ts, event_id) AS DOUBLE) AS value FROM i",
)
_lives = lambda s, d: _ticks(s, d).select("event_id", "ts", "user_id", (c("ts").cast("double") / 86_400).alias("day"), (F.floor(c("value") / 25) + 1).cast("double").alias("close"), (c("event_id") % 9 - 1).cast("double").alias("volume"), (c("event_id") % 4 == 0).cast("double").alias("acted"))
add(
    "st2_live_flags",
    lambda s, d: jobs.finish(jobs.stateful(_lives(s, d), "user_id", ["day", "close", "volume", "acted"], jobs.live_flags(0.3, 2, 2.0))),
    f"""{_WM}, v AS (SELECT user_id, event_id, ts, epoch_us(ts) / 86400000000.0 AS day, floor(value / 25) + 1 AS x, event_id % 9 - 1 AS vol, event_id % 4 = 0 AS acted FROM events, wm WHERE ts <= mark),
l AS (SELECT *, lag(x) OVER w AS px, lag(day) OVER w AS pd FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(CASE WHEN x = px THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS n FROM i)
SELECT user_id, event_id, CAST(CASE WHEN NOT acted AND abs(x / px - 1) > 0.3 THEN 1 ELSE 0 END + CASE WHEN vol <= 0 THEN 2 ELSE 0 END + CASE WHEN n > 2 THEN 4 ELSE 0 END + CASE WHEN day - pd > 2 THEN 8 ELSE 0 END AS DOUBLE) AS value FROM k""",
)
add("st3_once_each", lambda s, d: jobs.finish(jobs.once_each(_ticks(s, d), ["user_id", "event_type"])).groupBy("user_id", "event_type").agg(F.count("*").alias("n")), "SELECT user_id, event_type, CAST(1 AS BIGINT) AS n FROM events GROUP BY 1, 2")
add(
    "st4_kill_switch",
    lambda s, d: jobs.finish(jobs.stateful(_ticks(s, d).withColumn("value", (c("value") - 50) / 1000), "user_id", ["value"], jobs.kill_switch())),
    f"{_WM}, v AS (SELECT user_id, event_id, ts, product(1 + (value - 50) / 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eq FROM events, wm WHERE ts <= mark), k AS (SELECT *, greatest(1, max(eq) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM v) SELECT user_id, event_id, max(CASE WHEN 1 - eq / peak > 0.3 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM k",
)
add("st5_budgets", lambda s, d: jobs.finish(jobs.budgets(_ticks(s, d), "7 days", "4 days")), f"{_WM} SELECT event_type AS scope, CAST(date_trunc('week', ts) AS TIMESTAMP) AS period, sum(value) AS used, count(*) AS n FROM events, wm GROUP BY 1, 2 HAVING CAST(date_trunc('week', any_value(ts)) AS TIMESTAMP) + INTERVAL 7 DAYS <= any_value(mark)")
add("st6_sessions", lambda s, d: jobs.finish(jobs.sessions(_ticks(s, d))), f"{_WM}, n AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM n) SELECT user_id, min(ts) AS start, count(*) AS n, sum(value) AS total FROM i, wm GROUP BY user_id, run HAVING max(ts) + INTERVAL 6 HOURS <= any_value(mark)")
add(
    "st7_online_ema",
    lambda s, d: jobs.finish(jobs.stateful(_ticks(s, d), "event_type", ["value"], state.ema(10))),
    f"""{_WM.replace("WITH", "WITH RECURSIVE")}, v AS (SELECT event_type, event_id, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events, wm WHERE ts <= mark),
e(event_type, k, y) AS (SELECT event_type, CAST(10 AS BIGINT), avg(x) FROM v WHERE k <= 10 GROUP BY event_type HAVING count(*) = 10 UNION ALL SELECT v.event_type, v.k, {2 / 11!r} * x + {1 - 2 / 11!r} * y FROM e JOIN v ON v.event_type = e.event_type AND v.k = e.k + 1)
SELECT v.event_type, v.event_id, e.y AS value FROM v LEFT JOIN e ON e.event_type = v.event_type AND e.k = v.k""",
)
