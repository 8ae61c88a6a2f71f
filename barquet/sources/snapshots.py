"""Snapshots of bars: folders named by their content, and a manifest.

``folder/data/<id>`` holds a snapshot's bars, ``folder/manifest`` one small file
for each version of a snapshot's row. A snapshot is there once its first row is:
bars are written to a folder aside, moved in one step to the place that their
content names, and only then the row is created. A job that dies before that
leaves nothing that a reader sees, and one that runs again finds the row or makes it.
"""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("instrument", "date", "open", "high", "low", "close", "volume")
SCHEMA = (
    "snapshot_id string, version int, market string, timeframe string, asset_class string, period_start date, period_end date, n_bars long, n_instruments long, "
    "content string, status string, vaulted boolean, decided_by string, note string"
)
STATUSES = ("pending", "valid", "invalid")


class Files:
    """The file system of a folder, whichever Spark reads it by."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark._jvm
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def move(self, source: str, target: str) -> None:
        """In one step; the target must not be there."""
        self.fs.mkdirs(self.path(target).getParent())
        if self.exists(target) or not self.fs.rename(self.path(source), self.path(target)):
            raise FileExistsError(target)

    def create(self, name: str, text: str) -> bool:
        """Whether this call created the file; one that is there stays."""
        self.fs.mkdirs(self.path(name).getParent())
        try:
            out = self.fs.create(self.path(name), False)
        except Exception:  # the store's own kind of error
            if self.exists(name):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True


def content_of(bars: DataFrame) -> dict:
    """What a table of bars is, in any order of its rows: hashes, counts and dates in one pass."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), *FIELDS).cast("decimal(38,0)"))
    row = bars.agg(h(1).alias("a"), h(2).alias("b"), F.count("*").alias("n_bars"), F.count_distinct("instrument").alias("n_instruments"), F.min("date").alias("period_start"), F.max("date").alias("period_end")).first()
    return row.asDict() | {"content": f"{row['n_bars']}:{row['a'] or 0}:{row['b'] or 0}"}


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of every snapshot's row; rows that are not wholly written don't count."""
    files = Files(spark, folder)
    if not files.exists(f"{folder}/manifest"):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).json(f"{folder}/manifest").filter("snapshot_id IS NOT NULL AND status IS NOT NULL")
    newest = F.max_by(F.struct(*[f.strip().split()[0] for f in SCHEMA.split(",")][1:]), "version").alias("x")
    return rows.groupBy("snapshot_id").agg(newest).select("snapshot_id", "x.*")


def _row(spark: SparkSession, folder: str, snapshot_id: str) -> dict | None:
    found = manifest(spark, folder).filter(F.col("snapshot_id") == snapshot_id).first()
    return found.asDict() if found else None


def _publish(files: Files, folder: str, row: dict) -> bool:
    text = json.dumps(row, sort_keys=True, default=str)
    return files.create(f"{folder}/manifest/{row['snapshot_id']}.{row['version']:06d}.json", text + "\n")


def ingest(bars: DataFrame, folder: str, market: str, timeframe: str, asset_class: str, status: str = "pending") -> str:
    """Store ``bars`` (FIELDS, no repeated instrument and date) and give the snapshot's id.

    The id is that of content, market, timeframe and class: the same bars a
    second time, in any order or after a failure anywhere, are the same snapshot,
    with one row and one copy.
    """
    spark = bars.sparkSession
    files = Files(spark, folder)
    staged = f"{folder}/_staged/{uuid.uuid4().hex}"
    bars.select(*FIELDS).write.parquet(staged)
    try:
        kept = spark.read.schema(bars.select(*FIELDS).schema).parquet(staged)
        if repeated := kept.groupBy("instrument", "date").count().filter("count > 1").first():
            raise ValueError(f"two bars of {repeated['instrument']} on {repeated['date']}")
        known = content_of(kept)
        if not known["n_bars"]:
            raise ValueError("no bars")
        name = spark.range(1).select(F.sha2(F.lit("|".join((known["content"], market, timeframe, asset_class))), 256)).first()[0][:32]
        if _row(spark, folder, name) is None:
            target = f"{folder}/data/{name}"
            if files.exists(target):  # left by a job that died before its row
                files.remove(target)
            files.move(staged, target)
            about = {k: known[k] for k in ("period_start", "period_end", "n_bars", "n_instruments", "content")}
            _publish(files, folder, {"snapshot_id": name, "version": 0, "market": market, "timeframe": timeframe, "asset_class": asset_class, **about, "status": status, "vaulted": False})
        return name
    finally:
        files.remove(staged)


def decide(spark: SparkSession, folder: str, snapshot_id: str, by: str, status: str | None = None, vaulted: bool | None = None, note: str = "") -> int:
    """A new version of a snapshot's row, by name; of two that decide at once one is refused."""
    row = _row(spark, folder, snapshot_id)
    if row is None:
        raise KeyError(snapshot_id)
    if status is not None and status not in STATUSES:
        raise ValueError(f"no status {status}")
    if not by:
        raise ValueError("a decision has a name to it")
    row |= {"version": row["version"] + 1, "decided_by": by, "note": note} | ({"status": status} if status is not None else {}) | ({"vaulted": vaulted} if vaulted is not None else {})
    if not _publish(Files(spark, folder), folder, row):
        raise RuntimeError(f"{snapshot_id} has been decided meanwhile: look again")
    return row["version"]


def newest_usable(spark: SparkSession, folder: str, market: str, timeframe: str, asset_class: str) -> str | None:
    rows = manifest(spark, folder).filter("status = 'valid' AND NOT vaulted").filter((F.col("market") == market) & (F.col("timeframe") == timeframe) & (F.col("asset_class") == asset_class))
    found = rows.orderBy(F.desc("period_end"), F.desc("snapshot_id")).first()
    return found["snapshot_id"] if found else None


def load(spark: SparkSession, folder: str, snapshot_id: str, start: str | datetime.date | None = None, end: str | datetime.date | None = None, instruments: list[str] | None = None, vault: DataFrame | None = None) -> DataFrame:
    """A snapshot's bars, both dates included. Refused (ValueError) unless it is
    valid and not vaulted, and where what is asked for overlaps the ``vault``
    (instrument or null for all, locked_from, locked_to)."""
    row = _row(spark, folder, snapshot_id)
    if row is None:
        raise KeyError(snapshot_id)
    if row["status"] != "valid" or row["vaulted"]:
        raise ValueError(f"{snapshot_id} is {'vaulted' if row['vaulted'] else row['status']}")
    bars = spark.read.parquet(f"{folder}/data/{snapshot_id}")
    if start is not None:
        bars = bars.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.filter(F.col("date") <= F.lit(end).cast("date"))
    if instruments is not None:
        bars = bars.filter(F.col("instrument").isin(instruments))
    if vault is not None:
        locked = F.broadcast(vault.select(F.col("instrument").alias("__i"), "locked_from", "locked_to"))  # one row a lock, set by hand
        if hit := bars.join(locked, F.col("date").between(F.col("locked_from"), F.col("locked_to")) & (F.col("__i").isNull() | (F.col("__i") == F.col("instrument")))).select("instrument", "date").first():
            raise ValueError(f"{hit['instrument']} on {hit['date']} is in the vault")
    return bars
