"""Spec graphs as tables, all specs at once: checks, identity, walks.

Each round of a walk moves all specs one level, so rounds follow the deepest
graph. The walks take edges (``edges``): spec_id, node, operator, version,
input, role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import apart, written
from . import library

#: Operators whose result has no price unit, those that compare with a constant, and price columns with a unit.
UNIT_FREE = ["zscore", "percent_rank", "roc", "log_return", "frac_diff", "atr_normalise"]
LEVELS = ["threshold"]
RAW = ["price.open", "price.high", "price.low", "price.close"]


#: A spec's nodes are rows (spec_id, role, place, node, operator, version, params, inputs): ``params`` a map of texts as JSON
#: writes them, ``inputs`` a map from port to another node of the spec or to ``price.<column>``, ``version`` null for the
#: newest, ``place`` the order in the role. A node that serves several roles has an equal row in each.
SCHEMA = "spec_id long, role string, place int, node string, operator string, version string, params map<string,string>, inputs map<string,string>"
ROLES = ("entry", "exit", "filter", "risk")
SOURCE = "price."
Ids = tuple[str, ...]


def override(nodes: DataFrame, grid: DataFrame, ids: Ids = ("spec_id",)) -> DataFrame:
    """Every spec's nodes once for each row of ``grid`` (ids, params_ix, overrides:
    a map from ``node.param`` to a value), with these values in their parameters."""
    met = nodes.join(grid.select(*ids, "params_ix", "overrides"), list(ids))
    mine = F.map_filter("overrides", lambda k, v: F.startswith(k, F.concat("node", F.lit("."))))
    mine = F.transform_keys(mine, lambda k, v: F.substring(k, F.length("node") + 2, F.length(k)))
    params = F.coalesce("params", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(params, lambda k, v: ~F.array_contains(F.map_keys(mine), k)), mine)
    return met.withColumn("params", merged).drop("overrides")


def bound(nodes: DataFrame, ids: Ids = ("spec_id",)) -> DataFrame:
    """``nodes`` with their operator's version and all parameters in one written
    form, and ``problem``: why a node is refused, or null."""
    lib = library.table(nodes.sparkSession)
    names = lib.filter("newest").select("operator", F.col("version").alias("__newest"))
    known = lib.drop("newest").withColumn("__found", F.lit(True))
    rows = nodes.select(*ids, "role", "place", "node", "operator", "version", F.coalesce("params", F.create_map().cast("map<string,string>")).alias("params"), F.coalesce("inputs", F.create_map().cast("map<string,string>")).alias("inputs"))
    rows = rows.join(F.broadcast(names), "operator", "left").withColumn("version", F.coalesce("version", "__newest"))  # the library has some tens of rows
    rows = rows.join(F.broadcast(known), ["operator", "version"], "left")
    value = """transform(declared, d -> struct(d.name AS name, d.kind AS kind, d.low AS low, d.high AS high,
        trim(coalesce(params[d.name], d.default)) AS raw, try_cast(trim(coalesce(params[d.name], d.default)) AS double) AS x))"""
    written_as = """transform(given, g -> struct(g.name AS name,
        CASE g.kind WHEN 'int' THEN coalesce(CAST(try_cast(g.raw AS bigint) AS string), g.raw) WHEN 'float' THEN coalesce(CAST(g.x AS string), g.raw) ELSE g.raw END AS value,
        CASE g.kind WHEN 'int' THEN g.raw RLIKE '^-?[0-9]{1,18}$' WHEN 'float' THEN g.raw RLIKE '^[-+]?[0-9.]' AND g.x IS NOT NULL AND abs(g.x) < double('infinity') WHEN 'bool' THEN g.raw IN ('true', 'false') ELSE true END AS fits,
        coalesce(g.x >= g.low, g.low IS NULL) AND coalesce(g.x <= g.high, g.high IS NULL) AS within))"""
    rows = rows.withColumn("given", F.expr(value)).withColumn("given", F.expr(written_as))
    problem = F.expr("""CASE
        WHEN startswith(node, 'price.') THEN 'the name is a source'
        WHEN __newest IS NULL THEN 'unknown operator'
        WHEN __found IS NULL THEN 'unknown version'
        WHEN size(array_except(map_keys(params), transform(declared, d -> d.name))) > 0 THEN concat('unknown parameter ', array_join(array_sort(array_except(map_keys(params), transform(declared, d -> d.name))), ', '))
        WHEN exists(given, g -> NOT g.fits) THEN concat('wrong kind of ', array_join(transform(filter(given, g -> NOT g.fits), g -> g.name), ', '))
        WHEN exists(given, g -> NOT g.within) THEN concat('out of range: ', array_join(transform(filter(given, g -> NOT g.within), g -> g.name), ', '))
        WHEN size(ordered) = 2 AND CAST(filter(given, g -> g.name = ordered[0])[0].value AS double) > CAST(filter(given, g -> g.name = ordered[1])[0].value AS double) THEN concat(ordered[0], ' is above ', ordered[1])
        WHEN size(array_except(array_except(ports, implicit), map_keys(inputs))) > 0 THEN concat('unconnected input ', array_join(array_except(array_except(ports, implicit), map_keys(inputs)), ', '))
        WHEN size(array_except(map_keys(inputs), ports)) > 0 THEN concat('unknown input ', array_join(array_sort(array_except(map_keys(inputs), ports)), ', '))
        WHEN NOT role IN ('entry', 'exit', 'filter', 'risk') OR role IS NULL THEN 'unknown role' END""")
    rows = rows.withColumn("problem", problem)
    params = F.when(F.col("given").isNotNull(), F.map_from_arrays(F.col("given.name"), F.col("given.value"))).otherwise(F.col("params"))
    return rows.withColumn("params", params).select(*ids, "role", "place", "node", "operator", "version", "params", "inputs", "commutative", "problem")


def _text(pairs: str, by: str = "=") -> Column:
    """A map as text, by its sorted keys."""
    return F.expr(f"array_join(array_sort(transform(map_entries({pairs}), e -> concat(e.key, '{by}', e.value))), ',')")


def _levels(rows: DataFrame, ids: Ids) -> tuple[DataFrame, DataFrame]:
    """Structural hashes of the nodes: ``ids, node, h, level`` and the nodes of
    cycles. A round takes all nodes of all specs whose inputs are known."""
    own = [*ids, "node"]
    one = written(rows.groupBy(*own).agg(F.first(F.struct("operator", "version", "params", "inputs", "commutative")).alias("x")).select(*own, "x.*"))
    ports = written(one.select(*own, F.explode_outer("inputs").alias("port", "ref")))
    known, level = None, 0
    left = one
    while True:
        met = ports.join(apart(left.select(*own)), own)
        if known is not None:
            met = met.join(apart(known.select(*ids, F.col("node").alias("ref"), F.col("h").alias("of"))), [*ids, "ref"], "left")
        else:
            met = met.withColumn("of", F.lit(None).cast("string"))
        met = met.withColumn("of", F.when(F.startswith("ref", F.lit(SOURCE)), F.col("ref")).otherwise(F.col("of")))
        ready = met.groupBy(*own).agg(F.count_if(F.col("ref").isNotNull() & F.col("of").isNull()).alias("open"), F.collect_list(F.when(F.col("of").isNotNull(), F.struct("port", "of"))).alias("of")).filter("open = 0")
        by_port = F.expr("array_join(array_sort(transform(of, e -> concat(e.port, '=', e.of))), ',')")
        by_value = F.expr("array_join(array_sort(transform(of, e -> e.of)), ',')")
        h = F.sha2(F.concat_ws("|", F.concat("operator", F.lit("@"), "version"), _text("params"), F.when(F.col("commutative"), by_value).otherwise(by_port)), 256)
        found = written(ready.join(apart(left), own).select(*own, h.alias("h"), F.lit(level).alias("level"), F.map_from_entries("of").alias("of")))
        if found.isEmpty():
            return known, left.select(*own)
        known = found if known is None else written(known.unionByName(found))
        left = written(left.join(apart(found.select(*own)), own, "left_anti"))
        if left.isEmpty():
            return known, left.select(*own)
        level += 1


def structure(nodes: DataFrame, ids: Ids = ("spec_id",)) -> tuple[DataFrame, DataFrame]:
    """The specs that hold, with every node's ``h, level`` and inputs by hash
    (``of``), and the refused ones' ``ids, node, problem``.

    Equal hashes mean the same computation: operator, version, every bound
    parameter, and the inputs by port (of commutative operators in any order),
    whatever the nodes are called.
    """
    key = list(ids)
    rows = written(bound(nodes, ids))
    problems = rows.filter("problem IS NOT NULL").select(*key, "node", "problem")
    content = F.concat_ws("|", "operator", "version", _text("params"), _text("inputs"))
    twice = rows.groupBy(*key, "node").agg(F.count_distinct(content).alias("n")).filter("n > 1").select(*key, "node", F.lit("one name, two contents").alias("problem"))
    refs = rows.select(*key, "node", F.explode("inputs").alias("port", "ref")).filter(~F.startswith("ref", F.lit(SOURCE)))
    lost = refs.join(apart(rows.select(*key, F.col("node").alias("ref")).distinct()), [*key, "ref"], "left_anti").select(*key, "node", F.concat(F.lit("no node "), "ref").alias("problem"))
    problems = written(problems.unionByName(twice).unionByName(lost).distinct())
    good = rows.join(apart(problems.select(*key).distinct()), key, "left_anti").drop("problem")
    known, circular = _levels(good, ids)
    circular = circular.withColumn("problem", F.lit("in or above a cycle"))
    problems = written(problems.unionByName(circular))
    if known is None:
        known = good.select(*key, "node").withColumns({"h": F.lit(""), "level": F.lit(0), "of": F.col("node").cast("string")}).limit(0).withColumn("of", F.create_map().cast("map<string,string>"))
    good = good.join(apart(problems.select(*key).distinct()), key, "left_anti").join(apart(known), [*key, "node"])
    used = good.select(*key, "role", F.explode("inputs").alias("port", "node")).select(*key, "role", "node").distinct().withColumn("__used", F.lit(True))
    good = good.join(apart(used), [*key, "role", "node"], "left").withColumn("root", F.col("__used").isNull()).drop("__used")
    return written(good), problems


def roots(held: DataFrame, ids: Ids = ("spec_id",)) -> DataFrame:
    """``ids, entry, exit, filter, risk``: the hashes of each role's roots (nodes that none of the same role takes in), risk in its order."""
    lists = [F.collect_list(F.when((F.col("role") == r) & F.col("root"), F.struct("place", "h"))).alias(r) for r in ROLES]
    rows = held.groupBy(*ids).agg(*lists)
    sort = {r: F.array_sort(F.transform(r, lambda x: x["h"])) for r in ROLES[:3]} | {"risk": F.transform(F.array_sort("risk"), lambda x: x["h"])}
    return rows.withColumns(sort)


def structural_hashes(nodes: DataFrame, meta: DataFrame | None = None, ids: Ids = ("spec_id",)) -> DataFrame:
    """``ids, spec_hash`` of the specs that hold: the same for graphs that differ
    in the names or the order of their nodes, or in the order of commutative
    inputs; other parameters, ports, versions, universes and spec parameters
    (``meta``: ids, universe, parameters, as JSON texts with sorted keys) differ."""
    held, _ = structure(nodes, ids)
    rows = roots(held, ids)
    if meta is not None:
        rows = rows.join(meta.select(*ids, "universe", "parameters"), list(ids), "left")
    else:
        rows = rows.withColumns({"universe": F.lit(None).cast("string"), "parameters": F.lit(None).cast("string")})
    of = [F.concat(F.lit(f"{r}:"), F.array_join(F.array_sort(r), ",")) for r in ROLES]
    return rows.select(*ids, F.sha2(F.concat_ws(";", *of, F.coalesce("universe", F.lit("{}")), F.coalesce("parameters", F.lit("{}"))), 256).alias("spec_hash"))


def edges(nodes: DataFrame) -> DataFrame:
    """A row for each input: ``spec_id, node, operator, version, input, role``; one with a null input where a node has none."""
    return nodes.select("spec_id", "node", "operator", "version", F.explode_outer("inputs").alias("port", "input"), "role").drop("port")


def cones(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """``start`` (spec_id, node and labels) with every node upstream of each as
    ``up``, itself included: one level a round, until nothing is new."""
    edges = written(nodes.select("spec_id", F.col("node").alias("up"), F.col("input").alias("next")).distinct())
    seen = front = written(start.withColumn("up", F.col("node")).distinct())
    while True:
        front = front.join(apart(edges), ["spec_id", "up"]).drop("up").withColumnRenamed("next", "up").filter(~F.col("up").startswith("price."))
        front = written(front.select(*seen.columns).distinct().join(apart(seen), seen.columns, "left_anti"))
        if front.isEmpty():
            return seen
        seen = written(seen.union(front))


def usage(nodes: DataFrame) -> DataFrame:
    """``spec_id, role, operator``: the operators that each role's roots depend on, through any number of nodes."""
    used = nodes.select("spec_id", F.col("input").alias("node")).distinct()
    roots = nodes.select("spec_id", "node", "role").distinct().join(apart(used), ["spec_id", "node"], "left_anti")
    of = nodes.select("spec_id", F.col("node").alias("up"), "operator").distinct()
    return cones(nodes, roots).join(apart(of), ["spec_id", "up"]).select("spec_id", "role", "operator").distinct()


def absolute_levels(nodes: DataFrame) -> DataFrame:
    """``spec_id, node``: comparisons with a constant whose cone reaches a raw price and has no unit-free operator in it."""
    starts = nodes.filter(F.col("operator").isin(LEVELS)).select("spec_id", "node").distinct()
    of = nodes.select("spec_id", F.col("node").alias("up"), "operator", "input")
    cone = cones(nodes, starts).join(apart(of), ["spec_id", "up"]).groupBy("spec_id", "node")
    found = cone.agg(F.bool_or(F.col("operator").isin(UNIT_FREE)).alias("free"), F.bool_or(F.col("input").isin(RAW)).alias("raw"))
    return found.filter("raw AND NOT free").select("spec_id", "node")
