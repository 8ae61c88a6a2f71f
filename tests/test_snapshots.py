"""Snapshots and reports: once each, whole or not at all, whatever dies on the way."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barquet.sinks import reports
from barquet.sources import snapshots

DAY = dt.date(2020, 1, 1)


@pytest.fixture
def bars(spark):
    rows = [(i, DAY + dt.timedelta(days=k), 1.0, 2.0, 0.5, 1.0 + k, 10.0) for i in "ab" for k in range(20)]
    return spark.createDataFrame(rows, "instrument string, date date, open double, high double, low double, close double, volume double")


def rows_of(spark, folder):
    return snapshots.manifest(spark, folder).collect()


def test_the_same_bars_are_one_snapshot(spark, bars, tmp_path):
    folder = str(tmp_path)
    assert rows_of(spark, folder) == []
    first = snapshots.ingest(bars, folder, "m", "day", "equity")
    assert snapshots.ingest(bars.orderBy(F.desc("close")).repartition(3), folder, "m", "day", "equity") == first
    (row,) = rows_of(spark, folder)
    assert (row["n_bars"], row["n_instruments"], row["period_start"], row["period_end"], row["status"], row["version"]) == (40, 2, DAY, DAY + dt.timedelta(days=19), "pending", 0)
    other = snapshots.ingest(bars.withColumn("close", F.col("close") + 1), folder, "m", "day", "equity")
    assert other != first and snapshots.ingest(bars, folder, "m2", "day", "equity") not in (first, other)
    assert len(list((tmp_path / "data").iterdir())) == 3 and not list((tmp_path / "_staged").iterdir())


@pytest.mark.parametrize("at", ["move", "create"])
def test_a_job_that_dies_leaves_nothing_to_see(spark, bars, tmp_path, monkeypatch, at):
    folder = str(tmp_path)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(snapshots.Files, at, dies)
        with pytest.raises(KeyboardInterrupt):
            snapshots.ingest(bars, folder, "m", "day", "equity")
    assert rows_of(spark, folder) == []
    name = snapshots.ingest(bars, folder, "m", "day", "equity")
    snapshots.decide(spark, folder, name, "me", status="valid")
    assert snapshots.load(spark, folder, name).count() == 40 and len(rows_of(spark, folder)) == 1


def test_load_refuses(spark, bars, tmp_path):
    folder = str(tmp_path)
    name = snapshots.ingest(bars, folder, "m", "day", "equity")
    load = lambda **more: snapshots.load(spark, folder, name, **more)
    with pytest.raises(ValueError, match="pending"):
        load()
    snapshots.decide(spark, folder, name, "me", status="invalid", note="a gap")
    with pytest.raises(ValueError, match="invalid"):
        load()
    snapshots.decide(spark, folder, name, "me", status="valid")
    assert load().count() == 40 and load(start="2020-01-05", end="2020-01-06", instruments=["a"]).count() == 2
    vault = spark.createDataFrame([("b", dt.date(2020, 1, 10), dt.date(2020, 1, 12)), (None, dt.date(2020, 1, 20), dt.date(2021, 1, 1))], "instrument string, locked_from date, locked_to date")
    for more in ({}, {"instruments": ["b"], "end": "2020-01-10"}, {"instruments": ["a"], "start": "2020-01-20"}):
        with pytest.raises(ValueError, match="vault"):
            load(vault=vault, **more)
    assert load(vault=vault, end="2020-01-09").count() == 18 and load(vault=vault, instruments=["a"], end="2020-01-19").count() == 19
    snapshots.decide(spark, folder, name, "me", vaulted=True)
    with pytest.raises(ValueError, match="vaulted"):
        load()
    with pytest.raises(KeyError):
        snapshots.load(spark, folder, "nothing")


def test_decisions_have_a_name_and_an_order(spark, bars, tmp_path):
    folder = str(tmp_path)
    name = snapshots.ingest(bars, folder, "m", "day", "equity")
    for wrong in ({"by": ""}, {"by": "me", "status": "fine"}):
        with pytest.raises(ValueError):
            snapshots.decide(spark, folder, name, **wrong)
    assert [snapshots.decide(spark, folder, name, "me", status="valid"), snapshots.decide(spark, folder, name, "you", vaulted=True)] == [1, 2]
    (row,) = rows_of(spark, folder)
    assert (row["status"], row["vaulted"], row["decided_by"], row["version"]) == ("valid", True, "you", 2)
    # another one decided between looking and writing
    (tmp_path / "manifest" / f"{name}.000003.json").write_text('{"snapshot_id": "half a r')
    with pytest.raises(RuntimeError, match="meanwhile"):
        snapshots.decide(spark, folder, name, "me", status="invalid")
    assert rows_of(spark, folder)[0]["version"] == 2


def test_newest_usable(spark, bars, tmp_path):
    folder = str(tmp_path)
    names = [snapshots.ingest(bars.filter(F.col("date") < DAY + dt.timedelta(days=k)), folder, "m", "day", "equity") for k in (5, 10, 15, 20)]
    assert snapshots.newest_usable(spark, folder, "m", "day", "equity") is None
    for name, status in zip(names, ("valid", "valid", "valid", "invalid"), strict=True):
        snapshots.decide(spark, folder, name, "me", status=status)
    assert snapshots.newest_usable(spark, folder, "m", "day", "equity") == names[2]
    snapshots.decide(spark, folder, names[2], "me", vaulted=True)
    assert snapshots.newest_usable(spark, folder, "m", "day", "equity") == names[1] and snapshots.newest_usable(spark, folder, "m", "hour", "equity") is None


def test_bars_that_cannot_be_a_snapshot(spark, bars, tmp_path):
    with pytest.raises(ValueError, match="two bars of a"):
        snapshots.ingest(bars.union(bars.filter("instrument = 'a'").limit(1)), str(tmp_path), "m", "day", "equity")
    with pytest.raises(ValueError, match="no bars"):
        snapshots.ingest(bars.limit(0), str(tmp_path), "m", "day", "equity")
    assert rows_of(spark, str(tmp_path)) == []


def test_a_report_is_stored_once_and_whole(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    one = spark.createDataFrame([(1.0,)], "score double")
    assert reports.persist(folder, one, one, one, one, "a") and not reports.persist(folder, one, one, one, one, "a")
    moved, move = [], snapshots.Files.move

    def dies(self, *names):
        if len(moved) == 2:
            raise KeyboardInterrupt
        moved.append(names)
        move(self, *names)

    with monkeypatch.context() as m:
        m.setattr(snapshots.Files, "move", dies)
        with pytest.raises(KeyboardInterrupt):
            reports.persist(folder, one, one, one, one, "b")
    count = lambda: [reports.stored(spark, folder, t).count() for t in reports.TABLES]
    assert count() == [1, 1, 1, 1]
    assert reports.persist(folder, one, one, one, one, "b")
    assert count() == [2, 2, 2, 2] and {r["run_id"] for r in reports.stored(spark, folder, "evaluations").collect()} == {"a", "b"}
