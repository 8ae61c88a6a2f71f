"""URL filters (operator 6): rules, and trust and distrust over the host graph,
in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .decontamination import LOWER, UPPER

#: Trust and distrust are final where a round grows none of them by more than this share.
TOLERANCE = 1e-9

LINK = r"(?i)(?:href|src)\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"


def rule_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, path, action) with action ``allow`` or ``block``, as a DataFrame."""
    if not rules:
        return spark.createDataFrame([], "host string, path string, action string")
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in rules])))


def parts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return pages.select(F.col(id_col).alias("page_id"), F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, pattern, 2).alias("path"))


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst, n``: links between different hosts; summed before the shuffle."""
    links = pages.select(
        F.translate(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER).alias("src"),
        F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))).alias("dst"),
    )
    links = links.withColumn("dst", F.translate("dst", UPPER, LOWER))
    return links.filter("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = TOLERANCE) -> DataFrame:
    """``host, trust, distrust``: personalised PageRank from seeds
    (host, trust, distrust). Trust follows links and distrust runs against
    them; what reaches a host without a further link ends there.

    Rounds go on until no host is newly reached and no host's trust or
    distrust grows by more than ``tolerance`` of itself, however small it is,
    as verdicts are decided by ratios. No later round can then grow one by
    more. Rounds follow the longest way from a seed and the logarithm of the
    tolerance; what is less than a double can hold counts as nothing."""
    out, into = edges.groupBy("src").agg(F.sum("n").alias("all")), edges.groupBy("dst").agg(F.sum("n").alias("all"))
    forward = edges.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("all")).alias("w"))
    backward = edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("n") / F.col("all")).alias("w"))
    flow = materialise(forward.union(backward))
    seed = seeds.selectExpr("stack(2, 'trust', trust, 'distrust', distrust) AS (kind, value)", "host").filter("value > 0")
    rank = seed = materialise(seed.select("kind", "host", (F.col("value") * (1 - damping)).alias("value")))
    if not flow.isEmpty():  # without an edge the seeds are the result
        while True:
            nothing = F.lit(0.0).alias("before")
            moved = rank.join(flow, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("value") * F.col("w") * damping).alias("value"), nothing)
            before = rank.select("kind", "host", F.lit(0.0).alias("value"), F.col("value").alias("before"))
            rank = materialise(seed.select("*", nothing).union(moved).union(before).groupBy("kind", "host").agg(F.sum("value").alias("value"), F.sum("before").alias("before")))
            if rank.filter(F.col("value") - F.col("before") > tolerance * F.col("value")).isEmpty():
                break
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("value"))), F.lit(0.0)).alias(kind)
    return rank.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules: DataFrame, threshold: float = 0.75, damping: float = 0.85, tolerance: float = TOLERANCE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, trust, distrust``.

    A rule fits its host and all subdomains where the path starts with the
    rule's; the longest wins (of equally long ones the longer host, then
    ``block``). A page no rule fits gets its host's verdict: ``block`` where
    distrust is over ``threshold`` of trust and distrust, else ``allow``, also
    for a host that nothing reaches. A host's seeds are the shares of its pages
    that rules allow and block.

    Rules are looked up once per distinct host, by its suffixes; pages meet
    one row per host, so a hot host may be split. A null url, and one without
    ``://``, has an empty host and path. Null html has no links. Null ids and
    repeated rows are judged like any other; an empty table gives an empty
    result; other columns are ignored.
    """
    page = parts(pages, id_col, url_col)
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    rule = F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"), F.col("action"), F.col("rule_host"), F.col("rule_path"))
    named = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "action").distinct()
    fitting = page.groupBy("host").agg(F.count("*").alias("pages")).withColumn("suffix", suffix).join(named, F.col("suffix") == F.col("rule_host"))
    of_host = materialise(fitting.groupBy("host").agg(F.array_sort(F.collect_list(rule)).alias("rules")))

    best = F.element_at(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), -1)
    ruled = page.join(of_host, "host", "left").withColumn("best", F.when(F.exists("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), best))
    ruled = materialise(ruled.select("page_id", "host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), F.col("best.action").alias("action")))

    share = lambda action: F.avg(F.when(F.col("action") == action, 1.0).otherwise(0.0))
    seeds = ruled.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = materialise(propagate(seeds, materialise(host_edges(pages, url_col, html_col)), damping, tolerance))
    bad = F.coalesce(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), F.lit(False))
    return ruled.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("action", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
