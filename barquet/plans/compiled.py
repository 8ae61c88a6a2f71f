"""Specs over bars: every distinct computation of all specs once, in one plan."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import library, specs, state
from ..shared import apart, written

Keys = tuple[str, ...]

#: Distinct windows and recursions that one plan holds as columns; more specs make more plans over the same bars.
BATCH = 250
#: Distinct roots and computations that the driver may plan for; beyond, the caller deals the specs out.
MOST = 50_000
#: Specs up to which their table is broadcast to the signals' bars; beyond, both are shuffled, and a signal's bars are dealt in so many parts.
BROADCAST_ROWS, PARTS = 100_000, 16


@dataclasses.dataclass(frozen=True)
class Work:
    """A computation: an operator with bound parameters and the names of its inputs, or a combination of roots."""

    operator: str
    version: str
    params: tuple
    inputs: tuple  # (port, name), name a source or another work's


class Graph:
    """Distinct computations, each named once, inner ones included."""

    def __init__(self):
        self.names: dict[Work, str] = {}
        self.works: dict[str, Work] = {}

    def add(self, operator: str, version: str | None, params: dict, inputs: dict[str, str]) -> str:
        """The name of a computation; its operator's inner ones are added with it."""
        if operator not in COMBINED:
            found, params = library.bind(operator, version, **params)
            version = found.version
            if found.needs:
                for port, (inner, inner_params, ports) in found.needs(params).items():
                    inputs = inputs | {port: self.add(inner, None, inner_params, {p: inputs[q] for p, q in ports.items()})}
            if found.commutative:
                inputs = dict(zip(sorted(inputs), sorted(inputs.values()), strict=True))
        work = Work(operator, version or "", tuple(sorted(params.items())), tuple(sorted(inputs.items())))
        if work not in self.names:
            self.names[work] = f"__n{len(self.names)}"
            self.works[self.names[work]] = work
        return self.names[work]

    def cone(self, name: str, into: set[str]) -> None:
        """All works that ``name`` depends on, itself included."""
        todo = [name]
        while todo:
            at = todo.pop()
            if at in self.works and at not in into:
                into.add(at)
                todo += [x for _, x in self.works[at].inputs]

    def weight(self, names: set[str]) -> float:
        """Columns that a plan of ``names`` has, and a share of one for each value that is none."""
        plain = sum(w.operator in COMBINED or library.LIBRARY[w.operator, w.version].pointwise for w in map(self.works.get, names))
        return len(names) - plain + plain / 20

    def levels(self, names: set[str]) -> list[list[str]]:
        """``names`` in rounds: each has its inputs in rounds before."""
        rounds, done, left = [], set(), set(names)
        while left:
            ready = sorted(n for n in left if all(x not in self.works or x in done for _, x in self.works[n].inputs))
            rounds.append(ready)
            done |= set(ready)
            left -= set(ready)
        return rounds


def _roles(entries: Column, exits: Column, filters: Column) -> Column:
    """One entry root as it is, several by agreement; then exits and filters. Each is an array of values."""
    known = lambda xs: F.transform(xs, lambda x: F.coalesce(x, F.lit(0.0)))
    agreed = F.when(F.forall(known(entries), lambda x: x > 0), 1.0).when(F.forall(known(entries), lambda x: x < 0), -1.0).otherwise(0.0)
    entry = F.when(F.size(entries) == 0, 0.0).when(F.size(entries) == 1, F.coalesce(F.get(entries, F.lit(0)), F.lit(0.0))).otherwise(agreed)
    fires = F.when(F.size(exits) == 1, F.coalesce(F.get(exits, F.lit(0)) != 0, F.lit(True))).otherwise(F.exists(known(exits), lambda x: x != 0))
    return F.when(fires, 0.0).when(F.forall(known(filters), lambda x: x > 0), entry).otherwise(0.0)


def _final(position: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(position, F.lit(0.0)))) + F.lit(0.0)  # no -0.0


COMBINED = ("roles", "final")


def _typed(operator: str, version: str, params: dict[str, str]) -> dict:
    kinds = {p.name: p.kind for p in library.LIBRARY[operator, version].params}
    read = {"int": int, "float": float, "bool": lambda v: v == "true", "str": str}
    return {k: read[kinds[k]](v) for k, v in params.items()}


def planned(held: DataFrame, ids: Keys) -> tuple[Graph, list[str], DataFrame]:
    """The graph of all specs, the names of the distinct signals, and which spec
    has which (``ids, signal_ix``). The driver sees distinct nodes and distinct
    sets of roots only, at most ``MOST`` of each."""
    nodes = held.groupBy("h").agg(F.first(F.struct("operator", "version", "params", "of", "level")).alias("x")).select("h", "x.*")
    named = written(specs.roots(held, ids).withColumn("recipe", F.sha2(F.to_json(F.struct(*specs.ROLES)), 256)))
    recipes = named.groupBy("recipe").agg(F.first(F.struct(*specs.ROLES)).alias("x")).select("recipe", "x.*")
    rows, wanted = nodes.limit(MOST + 1).collect(), recipes.orderBy("recipe").limit(MOST + 1).collect()
    if max(len(rows), len(wanted)) > MOST:
        raise ValueError(f"over {MOST} distinct computations: deal the specs out over several calls")
    graph, by_hash = Graph(), {}
    risky = {}
    for r in sorted(rows, key=lambda r: (r["level"], r["h"])):
        inputs = {p: by_hash.get(x, x) for p, x in r["of"].items()}
        made = (r["operator"], r["version"], _typed(r["operator"], r["version"], r["params"]), inputs)
        waits = [p for p in library.LIBRARY[r["operator"], r["version"]].implicit if p not in inputs]
        if waits:  # its input is the running position of the spec
            risky[r["h"]] = made, waits
        else:
            by_hash[r["h"]] = graph.add(*made)
    signal_of, finals = {}, []
    for r in wanted:
        roots = {f"{role}.{i:04d}": by_hash[h] for role in specs.ROLES[:3] for i, h in enumerate(r[role])}
        position = graph.add("roles", None, {}, roots)
        for h in r["risk"]:
            if h in risky:
                (operator, version, params, inputs), waits = risky[h]
                position = graph.add(operator, version, params, inputs | {p: position for p in waits})
            else:
                position = by_hash[h]
        final = graph.add("final", None, {}, {"position": position})
        if final not in finals:
            finals.append(final)
        signal_of[r["recipe"]] = finals.index(final)
    table = held.sparkSession.createDataFrame(list(signal_of.items()), "recipe string, signal_ix int")
    return graph, finals, named.join(F.broadcast(table), "recipe").select(*ids, "signal_ix")  # at most MOST rows


def _list(values: list, kind: str) -> str:
    return f"array({', '.join(map(repr, values))})" if values and kind == "int" else f"CAST(array({', '.join(map(repr, values))}) AS array<{kind}>)"


def _let(body: Callable[[Column], Column]) -> Column:
    """``body`` of the values so far, bound once: what made them could else move into a lambda and run for each element."""
    return F.transform(F.array(F.col("__v")), body)[0]


def _picked(places: list[int]) -> Column:
    return _let(lambda v: F.transform(F.expr(_list(places, "int")), lambda j: F.get(v, j)))


def _pointwise(graph: Graph, names: list[str], place: dict[str, int], keys: Keys) -> Column:
    """The values of ``names``, which read their own bar alone, as one array:
    these computations are rows of a constant, not columns of the plan."""
    rows, kinds = [], {}
    for n in names:
        work = graph.works[n]
        code, _ = kinds.setdefault((work.operator, work.version), (len(kinds), work))
        refs: dict[str, list[int]] = {"i": [], "entry": [], "exit": [], "filter": []}
        for port, x in work.inputs:
            refs[port.split(".")[0] if work.operator == "roles" else "i"].append(place[x])
        lists = [_list(v, "int") for v in refs.values()]
        rows.append(f"struct({code} AS op, {lists[0]} AS i, {_list([float(v) for _, v in work.params], 'double')} AS p, {lists[1]} AS e, {lists[2]} AS x, {lists[3]} AS f)")

    def value(v: Column, d: Column) -> Column:
        at = lambda i: F.get(v, i)
        many = lambda ix: F.transform(ix, at)
        out = F.lit(None).cast("double")
        for code, work in kinds.values():
            if work.operator == "roles":
                made = _roles(many(d["e"]), many(d["x"]), many(d["f"]))
            elif work.operator == "final":
                made = _final(at(d["i"][0]))
            else:
                operator = library.LIBRARY[work.operator, work.version]
                params = {k: d["p"][j] == 1.0 if isinstance(v, bool) else d["p"][j] for j, (k, v) in enumerate(work.params)}
                made = operator.column({p: at(d["i"][j]) for j, (p, _) in enumerate(work.inputs)}, params, keys)
            out = F.when(d["op"] == code, made.cast("double")).otherwise(out)
        return out

    return _let(lambda v: F.transform(F.expr(f"array({', '.join(rows)})"), lambda d: value(v, d)))


def _evaluated(bars: DataFrame, graph: Graph, names: set[str], keep: list[str], keys: Keys) -> DataFrame:
    """``bars`` with ``__v``, the values of ``keep``. The values known so far are
    one array. In each round the step functions of all works run in one grouped
    map, windows in one projection, and what reads its own bar alone is one
    expression; a value that nothing needs any more goes."""
    rounds = graph.levels(names)
    sources = sorted({x for n in names for _, x in graph.works[n].inputs if x not in graph.works})
    own = bars.columns
    place = {x: i for i, x in enumerate(sources)}
    bars = bars.withColumn("__v", F.array(*[F.col(x.removeprefix(specs.SOURCE)).cast("double") for x in sources]) if sources else F.array().cast("array<double>"))
    value = lambda x: F.col("__v")[place[x]]
    for i, ready in enumerate(rounds):
        pointwise, columns, jobs, frames = [], {}, [], []
        for n in ready:
            work = graph.works[n]
            operator = library.LIBRARY.get((work.operator, work.version))
            if operator is None or operator.pointwise:
                pointwise.append(n)
            elif operator.column:
                columns[n] = operator.column({p: value(x) for p, x in work.inputs}, dict(work.params), keys).cast("double")
            elif operator.step:
                jobs.append((operator, n))
            else:
                frames.append((operator, n))
        if jobs or frames:
            taken = sorted({x for _, n in [*jobs, *frames] for _, x in graph.works[n].inputs})
            bars = bars.select(*bars.columns, *[value(x).alias(f"__x{place[x]}") for x in taken])
            ref = lambda n: {p: f"__x{place[x]}" for p, x in graph.works[n].inputs}
            if jobs:
                bars = state.run_many(bars, [([ref(n)[p] for p in o.rows], o.step(dict(graph.works[n].params)), n) for o, n in jobs], keys)
            for o, n in frames:
                bars = o.frame(bars, ref(n), n, dict(graph.works[n].params), keys)
        needed = set(keep) | {x for later in rounds[i + 1 :] for n in later for _, x in graph.works[n].inputs}
        made = [n for _, n in [*jobs, *frames]] + list(columns)
        kept = [x for x in place if x in needed]
        old = _picked([place[x] for x in kept])
        if columns:
            bars = bars.select(*bars.columns, *[v.alias(n) for n, v in columns.items()])
        parts = [old, *([F.array(*made)] if made else []), *([_pointwise(graph, pointwise, place, keys)] if pointwise else [])]
        bars = bars.select(*own, F.concat(*parts).alias("__v"))
        place = {x: j for j, x in enumerate([*kept, *made, *pointwise])}
    order = [place[x] for x in keep]
    return bars.select(*own, _picked(order).alias("__v"))


def signals_of(bars: DataFrame, held: DataFrame, ids: Keys = ("spec_id",), keys: Keys = ("instrument",), carry: Keys = ("date",), batch: int = BATCH) -> DataFrame:
    """``ids, keys, bar_ix, carry, signal`` of every spec in ``held`` (``specs.structure``) over every bar."""
    graph, finals, mine = planned(held, ids)
    sources = {x.removeprefix(specs.SOURCE) for w in graph.works.values() for _, x in w.inputs if x.startswith(specs.SOURCE)}
    if "returns" in sources and "returns" not in bars.columns:
        bars = bars.withColumn("returns", library.w.simple_return(F.col("close"), keys))
    if lost := sorted(sources - set(bars.columns)):
        raise ValueError(f"the bars have no {', '.join(lost)}")
    bars = bars.select(*dict.fromkeys([*keys, "bar_ix", *carry, *sorted(sources)]))
    plans, group, names = [], [], set()
    for i, name in enumerate(finals):
        more = set(names)
        graph.cone(name, more)
        if group and graph.weight(more) > batch:
            plans.append((group, names))
            group, more = [], set()
            graph.cone(name, more)
        group, names = [*group, (i, name)], more
    if group:
        plans.append((group, names))
    carried = [c for c in carry if c not in keys]
    out = None
    for group, names in plans:
        made = _evaluated(bars, graph, names, [n for _, n in group], keys)
        made = made.select(*keys, "bar_ix", *carried, F.posexplode("__v").alias("at", "signal")).withColumn("signal_ix", F.col("at") + group[0][0]).drop("at")  # a group's numbers follow each other
        out = made if out is None else out.unionByName(made)
    if out is None:
        raise ValueError("no spec holds")
    mine = written(mine)
    if mine.count() <= BROADCAST_ROWS:
        out = out.join(F.broadcast(mine), "signal_ix")
    else:  # a signal's bars are dealt in parts, so that one which many specs share is several tasks
        parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("__part")
        out = out.withColumn("__part", F.pmod(F.col("bar_ix"), F.lit(PARTS)).cast("int")).join(apart(mine.select("*", parts)), ["signal_ix", "__part"])
    return out.select(*ids, *keys, "bar_ix", *carried, "signal")


def apply_specs(bars: DataFrame, nodes: DataFrame, ids: Keys = ("spec_id",), keys: Keys = ("instrument",), carry: Keys = ("date",), refuse: bool = True, batch: int = BATCH) -> DataFrame:
    """The signal of every spec of ``nodes`` (``specs.SCHEMA``) at every bar.

    Entry roots that are several must agree on a sign, any exit root flattens,
    every filter root must be over 0, risk operators follow in their order on
    the running position, and the result lies within -1 and 1; a null is flat.
    Equal computations of all specs are worked out once. A spec that doesn't
    hold (``specs.structure``) is an error, or left out where ``refuse`` is off.
    """
    held, problems = specs.structure(nodes, ids)
    if refuse and (bad := problems.orderBy(*ids, "node").limit(5).collect()):
        raise ValueError("refused: " + "; ".join(f"{tuple(r[i] for i in ids)} {r['node']}: {r['problem']}" for r in bad))
    return signals_of(bars, held, ids, keys, carry, batch)


def warmup(nodes: DataFrame, ids: Keys = ("spec_id",)) -> DataFrame:
    """``ids, bars``: how many bars pass before a spec's last root is known, summed along its longest chain."""
    held, _ = specs.structure(nodes, ids)
    own = written(held.select(*ids, "node", "operator", "version", "params", "h", "level", "of").dropDuplicates([*ids, "node"]))
    distinct = own.groupBy("h").agg(F.first(F.struct("operator", "version", "params", "of", "level")).alias("x")).select("h", "x.*").limit(MOST + 1).collect()
    total: dict[str, int] = {}
    for r in sorted(distinct, key=lambda r: r["level"]):
        operator = library.LIBRARY[r["operator"], r["version"]]
        total[r["h"]] = operator.warmup(_typed(r["operator"], r["version"], r["params"])) + max((total.get(x, 0) for x in r["of"].values()), default=0)
    table = held.sparkSession.createDataFrame(list(total.items()), "h string, bars int")
    return own.join(F.broadcast(table), "h").groupBy(*ids).agg(F.max("bars").alias("bars"))
