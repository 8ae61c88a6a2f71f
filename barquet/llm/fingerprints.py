"""Document fingerprints (operator 12) by winnowing, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions_for

#: A unit is a run of at most so many signs of a word: words as a rule, pieces of a text without white space.
UNIT = 16
#: Units in a gram and grams in a window, powers of two: equal passages of GRAM + WINDOW - 1 units share an entry.
GRAM = WINDOW = 4
#: An entry is a long: the gram's hash above, the place of its first unit, counted from the end, in so many bits below.
PLACE_BITS = 28
LAST_PLACE = (1 << PLACE_BITS) - 1
#: Neighbours in the order of ids are brought together in blocks of so many bytes.
BLOCK_BYTES = 250_000
#: Ids and checksums, about 60 bytes a document, are broadcast up to so many; beyond, texts are shuffled by them once more.
BROADCAST_ROWS = 500_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def _neighbours(values: Column, by: int, merge: Callable[[Column, Column], Column]) -> Column:
    """Each value merged with the one ``by`` places after it."""
    n = F.greatest(F.size(values) - by, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(by + 1), n), merge)


def _doubled(values: Column, width: int, merge: Callable[[Column, Column], Column], then: Callable[[Column], Column], by: int = 1) -> Column:
    """``then`` of the merged runs of ``width`` values; ``width`` is a power of two."""
    return then(values) if by == width else let(_neighbours(values, by, merge), lambda x: _doubled(x, width, merge, then, 2 * by))


def winnow(text: Column) -> Column:
    """The entries of a text's fingerprint, in the order of their places.

    Units are runs of 1 to ``UNIT`` signs without white space. Every ``GRAM``
    consecutive units have a hash (of two halves', so one more level doubles
    the gram), every ``WINDOW`` consecutive grams give their smallest hash, the
    last one of equals. A text of fewer units than a gram is one gram, one of
    fewer grams than a window is one window, one without units (null, empty or
    white space) has no entry. Work grows with the text's length; arrays of
    about 60 bytes a unit are held for one text at a time.
    """
    none = F.array().cast("array<bigint>")

    def entries(hashes: Column) -> Column:
        packed = F.transform(hashes, lambda x, i: F.shiftleft(x, PLACE_BITS).bitwiseOR(F.lit(LAST_PLACE) - i))
        least = lambda v: F.when(F.size(v) < WINDOW, F.array_compact(F.array(F.array_min(v)))).otherwise(_doubled(v, WINDOW, lambda a, b: F.least(a, b), F.array_distinct))
        return let(packed, least)

    def of(units: Column) -> Column:
        few = F.when(F.size(units) == 0, none).otherwise(F.array(F.xxhash64(F.array_join(units, " "))))
        grams = let(F.transform(units, lambda x: F.xxhash64(x)), lambda h: _doubled(h, GRAM, lambda a, b: F.xxhash64(a, b), lambda x: x))
        return let(F.when(F.size(units) < GRAM, few).otherwise(grams), entries)

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\x20\x09-\x0D]{{1,{UNIT}}}"), F.lit(0)), of)


def hashes(entries: Column) -> Column:
    return F.array_distinct(F.transform(entries, lambda x: F.shiftright(x, PLACE_BITS)))


def likeness(entries: Column, others: dict[str, Column]) -> Column:
    """A struct with the Jaccard similarity of the hashes of ``entries`` to each of ``others``'; 1 if both are empty."""

    def to(own: Column, n: Column, other: Column) -> Column:
        shared = lambda theirs: let(F.size(F.array_intersect(own, theirs)), lambda both: F.when(n + F.size(theirs) == 0, 1.0).otherwise(both / (n + F.size(theirs) - both)))
        return let(hashes(other), shared)

    return let(hashes(entries), lambda own: let(F.size(own), lambda n: F.struct(*[to(own, n, other).alias(name) for name, other in others.items()])))


def written_out(entries: Column) -> Column:
    """Each entry in hexadecimal: ``hash * 2**28 + 2**28 - 1 - place``, the place being its first unit's number from 0."""
    return F.array_join(F.transform(entries, lambda x: F.hex(x)), " ")


def followers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, block, ghost, at, copies``: every document beside its follower.

    In the order of (doc_id, null last, then the text's checksum) each row's
    follower is the next row of its ``block`` in the order of (ghost, doc_id,
    checksum, variant), which ``at`` holds: the first document of a block is
    also the ghost at the end of the one before, and that of the first at the
    end of the last. Rows that repeat id and text are at most two, one of
    which stands for ``copies`` of them.

    Only ids, checksums and sizes are put in order, by ranges and sums of
    ranges; texts are shuffled once, by block.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = text.withColumn("sum", F.unhex(F.md5("text")))
    keys = materialise(keyed.groupBy("doc_id", "sum").agg(F.count("*").alias("rows"), (F.max(F.octet_length("text")) + 64).cast("long").alias("size")))
    n, nbytes, repeated = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0)) > 1).first()
    order = [F.col("doc_id").asc_nulls_last(), F.col("sum")]
    ranged = materialise(keys.repartitionByRange(partitions_for(n, 200_000, 8), *order).withColumn("range", F.spark_partition_id()))
    ends = ranged.groupBy("range").agg(F.sum("size").alias("in_range"), F.max_by("size", F.struct(F.col("doc_id").isNull(), "doc_id", "sum")).alias("end_size"))
    every = Window.partitionBy(F.lit(0)).orderBy("range")
    ends = ends.select("range", (F.sum("in_range").over(every) - F.col("in_range")).alias("before"), F.lag("end_size").over(every).alias("last_size"), F.last("end_size").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("end_size"))
    own = Window.partitionBy("range").orderBy(*order)
    placed = (
        ranged.withColumns({"through": F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)), "previous": F.lag("size").over(own)})
        .join(F.broadcast(ends), "range")
        .withColumn("start", F.col("before") + F.col("through") - F.col("size"))
        .withColumn("first", F.col("start") == 0)
        .withColumn("back", F.when(F.col("first"), F.lit(nbytes) - F.col("end_size")).otherwise(F.col("start") - F.coalesce("previous", "last_size")))
        .select("doc_id", "sum", "rows", "first", F.expr(f"start div {BLOCK_BYTES}").alias("block"), F.expr(f"back div {BLOCK_BYTES}").alias("behind"))
    )
    placed = materialise(placed)
    narrow = placed.select(F.col("doc_id").alias("__id"), F.col("sum").alias("__sum"), "rows", "first", "block", "behind")
    met = keyed.join(F.broadcast(narrow) if n <= BROADCAST_ROWS else narrow, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("sum") == F.col("__sum"))).drop("__id", "__sum")
    if repeated:
        many = met.filter("rows > 1").groupBy("doc_id", "sum", "rows", "first", "block", "behind").agg(F.first("text").alias("text"))
        met = met.filter("rows = 1").unionByName(many)
    place = lambda block, ghost, variant, copies: F.struct(block.alias("block"), F.lit(ghost).alias("ghost"), F.lit(variant).alias("variant"), copies.alias("copies"))
    places = F.array_compact(
        F.array(
            F.when(F.col("rows") > 1, place(F.col("block"), False, 0, F.col("rows") - 1)),
            place(F.col("block"), False, 1, F.lit(1).cast("long")),
            F.when(F.col("first") | (F.col("block") != F.col("behind")), place(F.col("behind"), True, 0, F.lit(1).cast("long"))),
        )
    )
    dealt = met.withColumn("p", F.explode(places)).select("doc_id", "text", "p.block", "p.ghost", "p.copies", F.struct("p.ghost", F.col("doc_id").isNull().alias("none"), "doc_id", "sum", "p.variant").alias("at"))
    return dealt.repartition(partitions_for(nbytes, 32 * BLOCK_BYTES, 16), "block")


def edited(text: Column, follower: Column) -> Column:
    """``text`` with its last quarter of code points, rounded down, replaced by as many (or all) of the follower's first."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(follower, F.lit(1), quarter))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, edited, entries, edited_entries, near_edited, near_next``,
    one row per document: its fingerprint (``winnow``), that of its edited text
    (``edited``, by the next document in the order of ids), and the likeness of
    its fingerprint to both the edited text's and the next document's.

    Null texts count as empty. Null ids come last; documents with one id follow
    each other by their texts' checksums, so rows that repeat id and text have
    each other as next. A single document follows itself. An empty table gives
    an empty result; other columns are ignored, whatever their names.
    """
    window = Window.partitionBy("block").orderBy("at")
    rows = followers(docs, id_col, text_col).withColumn("next", F.lead("text").over(window)).withColumn("entries", winnow(F.col("text")))
    rows = rows.withColumn("next_entries", F.lead("entries").over(window)).filter("NOT ghost").withColumn("edited", edited(F.col("text"), F.col("next")))
    rows = rows.withColumn("edited_entries", winnow(F.col("edited")))
    rows = rows.withColumn("near", likeness(F.col("entries"), {"edited": F.col("edited_entries"), "next": F.col("next_entries")}))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select("doc_id", "text", "edited", "entries", "edited_entries", F.col("near.edited").alias("near_edited"), F.col("near.next").alias("near_next"))
