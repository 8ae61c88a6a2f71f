"""Sinks of trades, curves and logs: typed also when they are empty."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_path
from ..sources.snapshots import Files

TRADE = "instrument string, side int, entry_date date, exit_date date, bars_held long, weight double, gross_return double, cost_return double, net_return double, open_at_end boolean"


def tradebook(trades: DataFrame) -> DataFrame:
    """Trades in the book's columns and types."""
    fields = [f.strip().split() for f in TRADE.split(",")]
    return trades.select(*[F.col(n).cast(t).alias(n) for n, t in fields])


def round_trip(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    path = new_path(df.sparkSession)
    writer = df.write
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tsv_round_trip(df: DataFrame) -> DataFrame:
    path = new_path(df.sparkSession)
    df.write.mode("append").option("header", True).csv(path, sep="\t")
    return df.sparkSession.read.option("header", True).schema(df.schema).csv(path, sep="\t")


TABLES = ("evaluations", "evaluation_tests", "evaluation_regimes", "provenance")


def persist(folder: str, scored: DataFrame, checks: DataFrame, regimes: DataFrame, provenance: DataFrame, run_id: str) -> bool:
    """Store one report in four tables: evaluation, check rows, regime rows,
    provenance, each row with the run's id. False if that run is there already.

    Each table's part is written aside and moved to its place in one step; a mark
    at the end says that all four are there, and ``stored`` reads marked runs
    alone. So a report that is written again doesn't double, and one whose job
    died is not seen and is made anew."""
    spark = scored.sparkSession
    files = Files(spark, folder)
    batch = f"batch=r{hashlib.sha256(run_id.encode()).hexdigest()[:24]}"
    mark = f"{folder}/_runs/{batch}.json"
    if files.exists(mark):
        return False
    for name, frame in zip(TABLES, (scored, checks, regimes, provenance), strict=True):
        staged = f"{folder}/_staged/{uuid.uuid4().hex}"
        frame.withColumn("run_id", F.lit(run_id)).write.parquet(staged)
        files.remove(f"{folder}/{name}/{batch}")
        files.move(staged, f"{folder}/{name}/{batch}")
    return files.create(mark, json.dumps({"batch": batch.removeprefix("batch="), "run_id": run_id}) + "\n")


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's rows of the runs that are there whole."""
    marks = spark.read.schema("batch string, run_id string").json(f"{folder}/_runs").select("batch")
    return spark.read.parquet(f"{folder}/{name}").join(F.broadcast(marks), "batch", "left_semi").drop("batch")  # one mark a run


def as_fields(report: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A report as rows (field, value), one a number."""
    names = [f.name for f in report.schema if f.name not in keys]
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("double").alias("value")) for n in names])
    return report.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*")


def as_markdown(report: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A report as one text a row: a table of its fields."""
    names = [f.name for f in report.schema if f.name not in keys]
    lines = [F.concat(F.lit(f"| {n} | "), F.coalesce(F.col(n).cast("string"), F.lit("")), F.lit(" |")) for n in names]
    return report.select(*keys, F.concat_ws("\n", F.lit("| field | value |"), F.lit("| --- | --- |"), *lines).alias("markdown"))
