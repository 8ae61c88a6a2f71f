"""Bars: from event tables to instrument-by-date panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ("open", "high", "low", "close", "volume")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_bars(ticks: DataFrame, instrument: Column, date: Column, price: Column, key: Column, volume: Column) -> DataFrame:
    """Open, high, low, close and volume of each instrument and date; first and last by ``key``."""
    return ticks.groupBy(instrument.alias("instrument"), date.alias("date")).agg(
        F.min_by(price, key).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, key).alias("close"),
        F.sum(volume).cast("double").alias("volume"),
    )


def order_bars(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """Weekly (or monthly) bars of the order value by priority."""
    return to_bars(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.date_trunc(unit, "o_orderdate").cast("date"), F.col("o_totalprice") / 1000, F.col("o_orderkey"), F.lit(1))


def item_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the unit price by return flag."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price)
    return to_bars(table(spark, sf_dir, "lineitem"), F.col("l_returnflag"), F.col("l_shipdate").cast("date"), price, key, F.col("l_quantity"))


def event_bars(spark: SparkSession, sf_dir: str, width: str = "6 hours") -> DataFrame:
    """Bars of the event value by type; ``date`` is the window's start."""
    return to_bars(table(spark, sf_dir, "events"), F.col("event_type"), F.window("ts", width)["start"], F.col("value"), F.struct("ts", "event_id"), F.lit(1))


def require_columns(bars: DataFrame, needed: tuple[str, ...] = ("date", "open", "high", "low", "close")) -> DataFrame:
    missing = [c for c in needed if c not in bars.columns]
    if missing:
        raise ValueError(f"bars lack the columns {missing}")
    return bars


def repeated_bars(bars: DataFrame) -> DataFrame:
    return bars.groupBy("instrument", "date").agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def panel(bars: DataFrame) -> DataFrame:
    """Every instrument on every date, with null where it has no bar.

    ``bar_ix`` counts the dates from 0. Dates and instruments are small next to
    bars; their product is the panel's size by definition.
    """
    dates = bars.select("date").distinct().withColumn("bar_ix", F.row_number().over(Window.orderBy("date")) - 1)
    grid = dates.crossJoin(bars.select("instrument").distinct())
    return grid.join(bars, ["instrument", "date"], "left").select("instrument", "date", "bar_ix", *FIELDS)


def load(bars: DataFrame, start: str | None = None, end: str | None = None, instruments: list[str] | None = None) -> DataFrame:
    """Bars between two dates, both included, of some instruments; filters reach the scan."""
    out = bars
    if start:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        out = out.filter(F.col("date") <= F.lit(end).cast("date"))
    return out.filter(F.col("instrument").isin(instruments)) if instruments else out
