"""A corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again before the next one. All but the last return the
columns of the input with fewer rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, exact_dedup, packing, quality, simhash
from .common import materialise, read_table
from .queries import LENGTH, tokenizer_path

#: Near copies: two documents whose sets of 5-word shingles have a similarity of 0.8 or more. Candidates are
#: found by 256-bit fingerprints within 63 bits, where 0.8 makes 39 bits differ on average, with a deviation of 6.
SIMILARITY, SHINGLE, BITS, RADIUS = 0.8, 5, 256, 63


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled rows of this stage's input.

    Null and empty texts have no compressed size to compare and get the score of
    the offset alone; null ids and repeated rows are scored like any other; a
    table without learnable labels scores one half, so all stay; other columns
    stay as they are."""
    return quality.keep_good(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays.

    A null text equals the empty one; a null id stays only where its group has
    no other; of rows that repeat id and text one stays; an empty table stays
    empty; other columns are those of the row that stays."""
    return exact_dedup.deduplicate(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Texts without words are one group; a null id goes where its group has
    another; an empty table stays empty; other columns stay as they are."""
    return simhash.deduplicate_similar(docs, SIMILARITY, RADIUS, SHINGLE, BITS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go.

    Null and empty texts hold none and stay, as do null ids and repeated rows
    without a hit; an empty benchmark or table changes nothing; other columns
    stay as they are."""
    return decontamination.remove_documents(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what is left, packed.

    A null or empty text is the end id alone; null ids and repeated rows are
    packed like any other; an empty table gives no sequence; other columns go."""
    return packing.pack(docs, tokenizer_path(), LENGTH)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No SQL states compression, fingerprints or packing; a brute-force version in the tests does.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
