"""Sources and sinks that need files of their own."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from barquet.plans import barquality
from barquet.sinks import reports
from barquet.sources import archive, bars


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_market_tree(spark, tmp_path):
    frame = spark.createDataFrame([("2001-01-02", 1.0, 2.0, 0.5, 1.5, 10.0)], "Date string, Open double, high double, low double, close double, volume double")
    for name in ("equities/1d/AAA", "equities/1d/BBB", "forex/1h/CCC"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        frame.toPandas().to_parquet(tmp_path / f"{name}.parquet")
    out = archive.market_tree(spark, str(tmp_path))
    assert {(r["asset_class"], r["timeframe"], r["instrument"], r["open"]) for r in out.collect()} == {("equities", "1d", "AAA", 1.0), ("equities", "1d", "BBB", 1.0), ("forex", "1h", "CCC", 1.0)}
    (tmp_path / "forex/1d").mkdir()
    frame.toPandas().to_parquet(tmp_path / "forex/1d/AAA.parquet")
    with pytest.raises(ValueError):
        archive.market_tree(spark, str(tmp_path))


def test_csv_imports(spark, tmp_path):
    (tmp_path / "a.csv").write_text("instrument,action_type,ex_date,ratio,verified_by\nA, split ,2001-03-01,0.5,x\nB,bonus,2002-03-01,0.5, \n")
    actions = archive.import_csv(spark, str(tmp_path / "a.csv"), "instrument string, action_type string, ex_date date, ratio double, verified_by string")
    rows = actions.orderBy("instrument").collect()
    assert rows[0]["action_type"] == "split" and rows[1]["verified_by"] is None
    with pytest.raises(ValueError):
        barquality.select_actions(actions)
    assert barquality.select_actions(actions, allow_unverified=True).count() == 2


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="close"):
        bars.require_columns(spark.range(1).select(F.lit(1).alias("date"), F.lit(1).alias("open"), F.lit(1).alias("high"), F.lit(1).alias("low")))


def test_empty_tradebook_is_typed(spark):
    empty = spark.createDataFrame([], reports.TRADE)
    back = reports.round_trip(reports.tradebook(empty))
    assert back.count() == 0 and [f"{f.name} {f.dataType.simpleString()}" for f in back.schema] == [x.strip().replace("long", "bigint") for x in reports.TRADE.split(",")]


def test_reports_append(spark, tmp_path):
    one = spark.createDataFrame([(1.0,)], "score double")
    for run in ("a", "b"):
        reports.persist(str(tmp_path), one, one, one, one, run)
    assert spark.read.parquet(str(tmp_path / "evaluation_tests")).count() == 2
