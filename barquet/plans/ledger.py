"""Queries over the ledger of experiments, knowledge, deployments and jobs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import apart, written
from .barquality import latest


def comparable(experiments: DataFrame, hashes: list[str]) -> DataFrame:
    """How many other experiments share all hashes with each one; one that lacks a
    hash is comparable with none."""
    whole = F.lit(True)
    for h in hashes:
        whole = whole & F.col(h).isNotNull()
    counts = experiments.filter(whole).groupBy(*hashes).agg((F.count("*") - 1).alias("n_comparable"))
    return experiments.join(counts, hashes, "left").withColumn("n_comparable", F.coalesce("n_comparable", F.lit(0)))


def mark_incomparable(experiments: DataFrame, **provenance: object) -> DataFrame:
    """``comparable``: false for experiments with all these values; none is deleted."""
    hit = F.lit(True)
    for name, value in provenance.items():
        hit = hit & F.coalesce(F.col(name) == F.lit(value), F.lit(False))
    return experiments.withColumn("comparable", F.coalesce("comparable", F.lit(True)) & ~hit) if "comparable" in experiments.columns else experiments.withColumn("comparable", ~hit)


def trial_counts(experiments: DataFrame, keys: list[str], iterations: str = "iteration_count") -> DataFrame:
    """Trials of a family (and market): the iterations of its experiments; an experiment without a count is none."""
    return experiments.groupBy(*keys).agg(F.coalesce(F.sum(iterations), F.lit(0)).alias("trials"))


#: Answers (a question and a finding) whose lists of ids one task joins.
ANSWERS = 200_000


def answered(questions: DataFrame, findings: DataFrame) -> DataFrame:
    """Open questions (question_id, priority, ids) by priority, with the sorted union
    of the ids of findings (finding_id, ids) that share one with them, and how many do.
    Lists meet in as many partitions as there are ``ANSWERS`` answers, so a task's don't grow with the input."""
    each = written(questions.select("question_id", F.explode("ids").alias("x")).join(findings.select("finding_id", F.explode("ids").alias("x")), "x").select("question_id", "finding_id").distinct())
    parts = max(1, -(-each.count() // ANSWERS))
    merged = apart(each.repartition(parts, "finding_id")).join(findings, "finding_id").repartition(parts, "question_id").groupBy("question_id").agg(F.count("*").alias("n_answers"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("more"))
    none = F.array().cast(questions.schema["ids"].dataType)
    out = questions.join(merged, "question_id", "left")
    return out.select("question_id", "priority", F.coalesce("n_answers", F.lit(0)).alias("n_answers"), F.array_sort(F.array_union("ids", F.coalesce("more", none))).alias("ids"))


def failure_patterns(entries: DataFrame, market: str, most: int = 10) -> DataFrame:
    """Entries (id, kind, markets, confidence) that speak against a strategy of a market: counter-evidence
    and failure patterns whose markets hold it, or that name none; the surest first."""
    fits = F.col("markets").isNull() | F.array_contains("markets", market)
    return entries.filter(F.col("kind").isin("counter_evidence", "failure_pattern") & fits).orderBy(F.desc("confidence"), "id").limit(most)


def sums_in_order(rows: DataFrame, key: str, values: list[str], order: list[str]) -> DataFrame:
    """Sums of doubles of each key, added one by one by ``order``, so that they don't
    depend on how rows are dealt; null where all are. A key's rows meet in one list."""
    each = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], *[F.col(v).cast("double").alias(v) for v in values])
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("own"))
    add = lambda s, x: F.when(s.isNull(), x).when(x.isNull(), s).otherwise(s + x)
    total = lambda v: F.aggregate(F.col("own"), F.lit(None).cast("double"), lambda s, x: add(s, x[v]))
    return lists.select(key, *[total(v).alias(v) for v in values])


def case_against(margins: DataFrame, regimes: DataFrame, key: str, nearest: int = 3, worst: int = 2) -> DataFrame:
    """What speaks against each candidate: the thresholds (name, value, threshold) that it
    clears by the smallest relative margin, and its regimes (regime, sharpe) with the lowest Sharpe."""
    margin = F.abs(F.try_divide(F.col("value") - F.col("threshold"), F.abs("threshold")))
    near = F.row_number().over(Window.partitionBy(key).orderBy(F.col("margin").asc_nulls_last(), "name"))
    low = F.row_number().over(Window.partitionBy(key).orderBy("sharpe", "regime"))
    a = margins.withColumn("margin", margin).withColumn("place", near).filter(F.col("place") <= nearest).select(key, F.lit("threshold").alias("kind"), "name", F.col("margin").alias("value"), "place")
    b = regimes.withColumn("place", low).filter(F.col("place") <= worst).select(key, F.lit("regime").alias("kind"), F.col("regime").alias("name"), F.col("sharpe").alias("value"), "place")
    return a.union(b)


def spec_classes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``family, spec_id, class_id`` of each spec, and ``family, class_id, n,
    items`` of each class: specs of a family with equal sets of (operator,
    version, role), named by the smallest. A class's items stand from the rarest
    among the family's classes to the most frequent."""
    item = F.concat_ws("/", "operator", "version", "role")
    specs = nodes.groupBy("family", "spec_id").agg(F.array_sort(F.collect_set(item)).alias("own"))
    classes = written(specs.groupBy("family", "own").agg(F.min("spec_id").alias("class_id"), F.count("*").alias("n")))
    members = specs.join(classes, ["family", "own"]).select("family", "spec_id", "class_id")
    each = classes.select("family", "class_id", "n", F.explode("own").alias("item"))
    often = each.groupBy("family", "item").agg(F.count("*").alias("df"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("df", "item"))), lambda x: x["item"])
    return members, written(each.join(often, ["family", "item"]).groupBy("family", "class_id", "n").agg(ordered.alias("items")))


def _without_few(items: Column) -> Column:
    """Array of (key, gone): the hash of ``items`` without 0, 1 or 2 of them, and how many are gone."""
    places = F.sequence(F.lit(0), F.size(items) - 1)
    key = lambda keep, n: F.struct(F.xxhash64(F.array_join(F.filter(items, keep), "\n")).alias("key"), F.lit(n).alias("gone"))
    one = F.transform(places, lambda i: key(lambda x, at: at != i, 1))
    two = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: key(lambda x, at: (at != i) & (at != j), 2))))
    return F.concat(F.array(key(lambda x, at: F.lit(True), 0)), one, two)


def class_pairs(classes: DataFrame, least: float = 0.8) -> DataFrame:
    """``family, a, b, jaccard`` of classes of a family whose sets are so similar.

    Small sets, of which at most two items may be lacking, meet in what they have
    in common: each is keyed by itself without 0, 1 or 2 of its items, so few
    sets share a key even if all share their items. Where one is larger, the two
    share one of the rarest items of either, as many as a pair may lack and one
    more, and meet there if their sizes allow it. They meet by ids alone, and
    only then are their items compared."""
    small = math.ceil(3 / (1 - least) - 1e-9) - 1 if least < 1 else 2**31 - 1
    sized = classes.select("family", F.col("class_id").alias("a"), F.size("items").alias("k"), "items")
    keyed = sized.filter((F.col("k") > 0) & (F.col("k") <= small)).select("family", "a", "k", F.explode(F.filter(_without_few(F.col("items")), lambda x: x["gone"] <= F.floor((1 - least) * F.col("k") + 1e-9))).alias("x")).select("family", "a", "k", "x.*")
    other = keyed.select("family", "key", F.col("a").alias("b"), F.col("gone").alias("gone2"))
    common = F.col("k") - F.col("gone")
    few = keyed.join(other.hint("merge"), ["family", "key"]).filter((F.col("a") < F.col("b")) & (common >= least * (common + F.col("gone") + F.col("gone2")) - 1e-9)).select("family", "a", "b")
    prefix = F.slice("items", 1, F.greatest(F.lit(1), (F.col("k") - F.ceil(F.lit(least) * F.col("k")) + 1).cast("int")))
    posted = sized.filter(F.col("k") >= least * (small + 1) - 1e-9).select("family", "a", "k", F.explode(prefix).alias("item"))
    other = posted.select("family", "item", F.col("a").alias("b"), F.col("k").alias("k2"))
    many = posted.join(other, ["family", "item"]).filter((F.col("a") < F.col("b")) & (F.greatest("k", "k2") > small) & (F.least("k", "k2") >= least * F.greatest("k", "k2"))).select("family", "a", "b")
    met = few.union(many).distinct()
    sets = classes.select("family", "class_id", "items")
    both = met.join(sets.withColumnsRenamed({"class_id": "a", "items": "x"}), ["family", "a"]).join(sets.withColumnsRenamed({"class_id": "b", "items": "y"}), ["family", "b"])
    common = F.size(F.array_intersect("x", "y"))
    return both.select("family", "a", "b", (common / (F.size("x") + F.size("y") - common)).alias("jaccard")).filter(F.col("jaccard") >= least)


def near_duplicates(nodes: DataFrame, least: float = 0.8) -> DataFrame:
    """``family, spec_id, class_id, n_links``, one row a spec: the class it is in
    and how many other specs of its family are as similar, those of its own
    class included. ``class_pairs`` says which classes link."""
    members, classes = spec_classes(nodes)
    pairs = class_pairs(classes, least)
    ends = pairs.select("family", F.col("a").alias("class_id"), F.col("b").alias("other")).union(pairs.select("family", "b", "a"))
    linked = ends.join(classes.select("family", F.col("class_id").alias("other"), F.col("n").alias("m")), ["family", "other"]).groupBy("family", "class_id").agg(F.sum("m").alias("m"))
    counts = classes.select("family", "class_id", "n").join(linked, ["family", "class_id"], "left").select("family", "class_id", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
    return members.join(counts, ["family", "class_id"]).select("family", "spec_id", "class_id", "n_links")


def registry_sync(have: DataFrame, want: DataFrame) -> DataFrame:
    """Counts of inserted, updated, unchanged and gone entries (name, hash)."""
    both = have.withColumnRenamed("hash", "old").join(want.withColumnRenamed("hash", "new"), "name", "full")
    kind = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "gone").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def edge_observations(observed: DataFrame) -> DataFrame:
    """One row a (subject, predicate, object): evidence for and against, backing ids, first and last time, last confidence."""
    triple = ["subject", "predicate", "object"]
    backed = observed.filter(F.size("backing") > 0)
    # Ids become distinct before they meet in a list.
    ids = backed.select(*triple, F.explode("backing").alias("id")).distinct().groupBy(*triple).agg(F.array_sort(F.collect_list("id")).alias("backing"))
    counts = backed.groupBy(*triple).agg(
        F.count_if("supports").alias("n_for"),
        F.count_if(~F.col("supports")).alias("n_against"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        F.max_by("confidence", F.struct("at", "confidence")).alias("confidence"),
    )
    renamed = ids.select(*[F.col(k).alias(f"__{k}") for k in triple], "backing")
    met = counts.join(renamed, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in triple], "left")
    return met.select(*triple, "n_for", "n_against", F.coalesce("backing", F.array().cast(ids.schema["backing"].dataType)).alias("backing"), "first_at", "last_at", "confidence")


def repeat_failures(failures: DataFrame, entries: DataFrame) -> DataFrame:
    """Share of failed experiments whose reason was known from an older entry of their market (null: any).

    The oldest entry of each reason and market decides, so that the join meets one row."""
    oldest = entries.groupBy("reason", "market").agg(F.min("at").alias("known_at"))
    anywhere = oldest.filter("market IS NULL").select("reason", F.col("known_at").alias("any_at"))
    joined = failures.join(oldest.filter("market IS NOT NULL"), ["reason", "market"], "left").join(anywhere, "reason", "left")
    known = F.coalesce(F.least("known_at", "any_at") < F.col("at"), F.lit(False))
    return joined.agg(F.count("*").alias("failures"), F.count_if(known).alias("repeated"), F.coalesce(F.try_divide(F.count_if(known), F.count("*")), F.lit(0.0)).alias("rate"))


def newest_per_family(failures: DataFrame, most: int = 50) -> DataFrame:
    order = Window.partitionBy("family").orderBy(F.desc("at"), F.desc("id"))
    ranked = failures.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most)
    return ranked.groupBy("family", "reason").agg(F.count("*").alias("n"))


def survival(deployments: DataFrame, months: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """Of deployments old enough, the share that was still alive so many months in."""
    each = deployments.withColumn("months", F.explode(F.array(*map(F.lit, months))))
    old = F.floor(F.months_between("now", "started")) >= F.col("months")
    alive = F.col("ended").isNull() | (F.floor(F.months_between("ended", "started")) >= F.col("months"))
    return each.filter(old).groupBy("months").agg(F.count("*").alias("n"), (F.count_if(alive) / F.count("*")).alias("share"))


def stage_counts(strategies: DataFrame, stages: list[str]) -> DataFrame:
    """All stages in order, zero where none is."""
    dim = strategies.sparkSession.createDataFrame([(i, s) for i, s in enumerate(stages)], "place int, stage string")
    return dim.join(strategies.groupBy("stage").agg(F.count("*").alias("n")), "stage", "left").select("place", "stage", F.coalesce("n", F.lit(0)).alias("n"))


def streak(frame: DataFrame, key: str, order: list[str], improved: Column) -> DataFrame:
    """``streak``: results in a row without an improvement, up to each one."""
    by = Window.partitionBy(key).orderBy(*order)
    kept = F.sum(F.when(improved, 1).otherwise(0)).over(by)
    marked = frame.withColumn("__island", kept)
    return marked.withColumn("streak", F.sum(F.when(improved, 0).otherwise(1)).over(Window.partitionBy(key, "__island").orderBy(*order))).drop("__island")


def illegal_transitions(log: DataFrame, allowed: DataFrame) -> DataFrame:
    """Status changes (entity, at, id, status) that no allowed pair (before, status) covers."""
    by = Window.partitionBy("entity").orderBy("at", "id")
    moved = log.withColumn("before", F.lag("status").over(by)).filter(F.col("before").isNotNull() & (F.col("before") != F.col("status")))
    return moved.join(F.broadcast(allowed), ["before", "status"], "left_anti")


def quarantine(jobs: DataFrame, last: int = 3) -> DataFrame:
    """Entities whose last terminal jobs all failed, if they have so many."""
    recent = jobs.withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("at"), F.desc("id")))).filter(F.col("k") <= last)
    return recent.groupBy("entity").agg(F.count("*").alias("n"), F.min(F.col("failed").cast("int")).alias("all_failed")).filter((F.col("n") == last) & (F.col("all_failed") == 1)).select("entity")


def budget_use(use: DataFrame, limit: float, period: str) -> DataFrame:
    return use.groupBy("scope", F.date_trunc(period, "at").alias("period")).agg(F.sum("amount").alias("used")).withColumn("exhausted", F.col("used") >= limit)


def ordered_json(frame: DataFrame, key: str, fields: list[str]) -> DataFrame:
    return frame.groupBy(key).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*fields)))).alias("rows"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["latest"]
