"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result to the shared folder as Parquet
and reads it back as the next one's documents. All but the last return the columns of ``documents``.

A column that a stage needs and that has another type is cast; null ids and texts pass every filter but the language
stage, which rejects texts without a letter; of equal rows and of near copies the one of the smallest id stays, of those with
one id an arbitrary but fixed one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanweave.llm import langid, linededup, mixing, neardup, packing
from loanweave.llm.common import read, saved
from loanweave.session import removed, scratch_path, scratch_scope

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.5  # a language that is less likely than not is no language


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised."""
    found = langid.identify(docs.select(*COLUMNS))
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each text by the lines it keeps."""
    kept = linededup.dedup_lines(docs.select(*COLUMNS))
    changed = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text"))
    return kept.withColumn("text", changed).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies, that of the smallest id, and every row without a near copy.

    Ids may repeat or be null, so rows are told apart by a key that is written with them.
    """
    keyed = saved(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "keyed")
    found = neardup.near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text"))
    place = F.struct(
        F.col("doc_id").isNull().alias("nameless"), "doc_id", F.md5("text").alias("digest"), "source", "lang", "n_chars", "_row"
    )
    places = keyed.select("_row", place.alias("place"))
    groups = found.select(F.col("doc_id").alias("_row"), "component_id").join(places, "_row").groupBy("component_id")
    kept = groups.agg(F.min("place").alias("place")).select("place._row")
    return keyed.join(kept.hint("shuffle_hash"), "_row", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order; one that the mix uses twice comes twice, one that it leaves out goes."""
    return mixing.curriculum(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

# Language scores are those of a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. A stage's intermediate tables, and the documents that it read, go when its result is
    written; the last result is lazy and keeps what it reads."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        with scratch_scope(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        if before:
            removed(spark, before)
        docs, before = spark.read.schema(result.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
