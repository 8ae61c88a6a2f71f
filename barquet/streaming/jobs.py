"""Structured Streaming twins: bars, ledgers, kill switch, budgets, sessions, recursions.

Each job is a function of a streaming frame; ``finish`` runs one over what is
there now and returns the table that it wrote.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from ..operators.state import Step, _number
from ..shared import new_path
from ..sources.snapshots import Files

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New files of the events table; a bounded number of files a batch."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 100).parquet(f"{sf_dir}/events.parquet*")


def sink(table: str, complete: bool = False) -> Callable[[DataFrame, int], None]:
    """Writes a batch into a folder of its own, named by the batch's number, so a
    batch that is run again replaces what it wrote; with ``complete`` each batch is the whole table."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(table if complete else f"{table}/batch={number}")

    return write


def finish(job: DataFrame | Stepped, mode: str = "append", log: str | None = None, table: str | None = None) -> DataFrame:
    """Runs a job over what is there now, and returns what it wrote so far. With
    the same ``log`` and ``table`` a later call goes on where this one ended."""
    spark = job.sparkSession
    table, log = table or new_path(spark), log or new_path(spark)
    stream, write = (job.ticks, job.sink(table)) if isinstance(job, Stepped) else (job, sink(table, mode == "complete"))
    stream.writeStream.outputMode(mode).option("checkpointLocation", log).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    if isinstance(job, Stepped):
        job.end(table)
    if mode == "complete":
        return spark.read.schema(job.schema).parquet(table)
    spark.createDataFrame([], job.schema).write.mode("overwrite").parquet(f"{table}/batch=-1")  # typed also where nothing is final yet
    return spark.read.schema(StructType([*job.schema.fields, StructField("batch", LongType())])).parquet(table).select(*job.columns)


#: How long after an event those before it may still come. What is older is dropped, and what isn't older isn't final yet.
LATE = "1 hour"


def tick_bars(ticks: DataFrame, width: str = "6 hours", late: str = LATE) -> DataFrame:
    """Bars of windows that the watermark has passed."""
    key = F.struct("ts", "event_id")
    return ticks.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("event_type").alias("instrument")).agg(F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").alias("volume")).select("instrument", F.col("window.start").alias("date"), "open", "high", "low", "close", "volume")


def once_each(trades: DataFrame, keys: list[str], late: str = "40 days") -> DataFrame:
    return trades.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def budgets(use: DataFrame, period: str = "1 day", start: str = "0 days", late: str = LATE) -> DataFrame:
    """Use by scope and day, or by week from Monday with ``7 days`` and ``4 days``, of periods that are over."""
    return use.withWatermark("ts", late).groupBy(F.window("ts", period, period, start), F.col("event_type").alias("scope")).agg(F.sum("value").alias("used"), F.count("*").alias("n")).select("scope", F.col("window.start").alias("period"), "used", "n")


def sessions(trades: DataFrame, gap: str = "6 hours", late: str = LATE) -> DataFrame:
    """Runs of a user's trades without a gap, once no trade can join them any more."""
    return trades.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("session_window.start").alias("start"), "n", "total")


def in_order(step: Step) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Steps sorted rows, with a state before them where there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Values of sorted rows, and a row with its state at each key's end; a batch is all that is held."""
        begun, key, state, last = False, None, None, 0

        def made(kinds: list[pa.DataType], out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out) if out else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "event_id", "value", "state", "last"])

        kinds = None
        for batch in batches:
            kinds = [batch.schema.field("key").type, batch.schema.field("event_id").type, pa.float64(), pa.binary(), pa.int64()]
            out, own = [], [c.to_pylist() for c in batch.columns]
            for k, at, i, *row, stored, before in zip(*own):
                if not begun or k != key:
                    if begun:
                        out.append((key, None, None, pickle.dumps(state), last))
                    begun, key, state, last = True, k, None, 0
                if at is None:
                    state, last = pickle.loads(stored), before
                    continue
                state, value = step(state, tuple(map(_number, row)))
                out.append((k, i, _number(value), None, None))
                last = at
            yield made(kinds, out)
        if begun:
            yield made(kinds, [(key, None, None, pickle.dumps(state), last)])

    return run


@dataclass(frozen=True)
class Stepped:
    """What ``stateful`` returns and ``finish`` runs."""

    ticks: DataFrame
    key: str
    inputs: list[str]
    step: Step
    late: str
    forget_days: float

    @property
    def sparkSession(self) -> SparkSession:  # noqa: N802  (as a DataFrame names it)
        return self.ticks.sparkSession

    @property
    def schema(self) -> StructType:
        own = self.ticks.schema
        return StructType([StructField(self.key, own[self.key].dataType), StructField("event_id", own["event_id"].dataType), StructField("value", DoubleType())])

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def sink(self, table: str) -> Callable[[DataFrame | None, int], None]:
        """A batch's values in a folder by its number, as ``sink`` has them, and beside
        them what the next step needs: states, rows that wait, and marks. A batch steps
        what the batches before it have made final; no batch is the end of a run, which
        steps what all have. Each reads the step before, so one that is run again does the same again."""
        of = lambda what, place: f"{table}/_held/{what}/step={place}"
        names, types = [f"in{i}" for i in range(len(self.inputs))], {f.name: f.dataType for f in self.ticks.schema}
        key, event = StructField("key", types[self.key]), StructField("event_id", types["event_id"])
        row = StructType([key, StructField("at", LongType()), event, *[StructField(n, types[c]) for c, n in zip(self.inputs, names)]])
        done = StructType([key, event, StructField("value", DoubleType()), StructField("state", BinaryType()), StructField("last", LongType())])
        forget = int(self.forget_days * 86_400_000_000)

        def write(batch: DataFrame | None, number: int) -> None:
            spark = self.sparkSession if batch is None else batch.sparkSession
            place = 2 * number + (batch is None)
            # ``mark``: what the rows so far have made final; ``stepped``: what has been stepped.
            marks = spark.read.schema("mark long, stepped long, step long").parquet(f"{table}/_held/marks").filter(F.col("step") < place).orderBy(F.desc("step")).first() if place else None
            rows = spark.createDataFrame([], row)
            mark = seen = marks["mark"] if marks else None
            if batch is not None:
                time = F.col("ts").cast("timestamp")
                own = batch.select(F.col(self.key).alias("key"), F.unix_micros(time).alias("at"), "event_id", *[F.col(c).alias(n) for c, n in zip(self.inputs, names)])
                rows = own.filter("at IS NOT NULL" if marks is None or marks["stepped"] is None else F.col("at") > marks["stepped"] * 1000)
                late = F.unix_millis(F.timestamp_millis(F.lit(0)) + F.expr(f"INTERVAL '{self.late}'"))
                seen = max((m for m in (mark, batch.agg(F.unix_millis(F.max(time)) - late).first()[0]) if m is not None), default=None)
            final = F.lit(False) if mark is None else F.col("at") <= mark * 1000
            states = spark.createDataFrame([], done)
            if marks:
                waiting = spark.read.schema(row).parquet(of("waiting", marks["step"]))
                states = spark.read.schema(done).parquet(of("stepped", marks["step"])).filter("state IS NOT NULL")
                if marks["stepped"] is not None:
                    over = F.col("last") + forget <= marks["stepped"] * 1000 + 999
                    held = waiting.select(F.col("key").alias("waits")).distinct()
                    states = states.filter(~over).union(states.filter(over).join(held, F.col("key").eqNullSafe(F.col("waits")), "left_semi"))
                rows = rows.union(waiting)
            # Spark sorts, and spills where it must; a key's state comes first, having no time.
            ready = rows.filter(final).unionByName(states.select("key", "state", "last"), allowMissingColumns=True)
            ordered = ready.repartition("key").sortWithinPartitions("key", "at", "event_id")
            ordered.mapInArrow(in_order(self.step), done).write.mode("overwrite").parquet(of("stepped", place))
            rows.filter(~final).write.mode("overwrite").parquet(of("waiting", place))
            values = spark.read.schema(done).parquet(of("stepped", place)).filter("state IS NULL")
            sink(table)(values.select(F.col("key").alias(self.key), "event_id", "value"), -2 - number if batch is None else number)
            spark.createDataFrame([(seen, mark)], "mark long, stepped long").write.mode("overwrite").parquet(of("marks", place))

        return write

    def end(self, table: str) -> None:
        """Steps what is final now, unless that has been done or nothing has come yet."""
        if not Files(self.sparkSession, table).exists(f"{table}/_held/marks"):
            return
        last = self.sparkSession.read.schema("mark long, stepped long, step long").parquet(f"{table}/_held/marks").agg(F.max("step")).first()[0]
        if last % 2 == 0:
            self.sink(table)(None, last // 2)


def stateful(ticks: DataFrame, key: str, inputs: list[str], step: Step, late: str = LATE, forget_days: float = 400.0) -> Stepped:
    """``key, event_id, value``: a step function of ``operators.state`` over each
    key's rows in the order of (ts, event_id), batch after batch; ``finish`` runs it.

    Rows wait until the latest time seen, less ``late``, has passed them, so that rows
    that come out of order within ``late`` are stepped in order; later ones are
    dropped. Waiting rows and states are tables, and Spark sorts what is stepped, so
    no worker holds a key's rows. A key's state ends when it has had no row for
    ``forget_days``, and a row after that starts anew. Rows without a time are dropped."""
    return Stepped(ticks, key, inputs, step, late, forget_days)


def kill_switch(most_drawdown: float = 0.3) -> Step:
    """Rows (net,): 1 from the first breach of the drawdown from the peak on."""

    def step(state, row):
        equity, peak, dead = state or (1.0, 1.0, 0.0)
        equity *= 1 + (row[0] or 0.0)
        peak = max(peak, equity)
        dead = 1.0 if dead or 1 - equity / peak > most_drawdown else 0.0
        return (equity, peak, dead), dead

    return step


def stale_run() -> Step:
    """Rows (close,): how many equal closes in a row end here."""

    def step(state, row):
        last, n = state or (None, 0)
        n = n + 1 if row[0] is not None and row[0] == last else 1
        return (row[0], n), float(n)

    return step


def live_flags(jump: float = 0.3, stale: int = 5, gap_days: float = 5.0) -> Step:
    """Rows (day, close, volume, acted): the flags of bars' quality as they come,
    added up: 1 for a jump with no action near it, 2 for no or a negative volume,
    4 for a run of equal closes that has grown too long, 8 for a gap in days."""

    def step(state, row):
        day, close, volume, acted = row
        before, since, n = state or (None, None, 0)
        n = n + 1 if close is not None and close == before else 1
        flags = 1.0 if before and close is not None and not acted and abs(close / before - 1) > jump else 0.0
        flags += (2.0 if volume is not None and volume <= 0 else 0.0) + (4.0 if n > stale else 0.0)
        flags += 8.0 if since is not None and day - since > gap_days else 0.0
        return (close, day, n), flags

    return step
