"""The operators as registered queries, with production parameters over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    balltree,
    hardneg,
    itq,
    langid,
    licenses,
    linededup,
    mixing,
    neardup,
    packing,
    quality,
    toxicity,
    trietokens,
    whitening,
)
from .common import fold, read
from .sql import HARD_NEGATIVES_SQL, LICENSE_SQL, LINES_SQL, MIX_SQL, TOP_K_SQL

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(read(spark, sf_dir, "documents"))
    held_out = F.coalesce(fold(F.col("doc_id")) == langid.HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.link_vectors(read(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trietokens.token_counts(read(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold(F.col("doc_id")) == quality.HELD_OUT, F.lit(False))
    predicted = (F.col("score") >= quality.CUT).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("sentence_ids").cast("bigint").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(read(spark, sf_dir, "embeddings"))
    # Beyond a long, which takes some ten million rows, the deviation is held at the largest one.
    deviation = F.least("deviation", F.lit(2**63 - 1).cast("decimal(38,0)")).cast("bigint")
    return found.withColumn("deviation", deviation)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT, F.lit(False))
    predicted = (F.col("score") >= toxicity.CUT).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hardneg.mine(read(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Query] = {
    fn.__name__: fn
    for fn in (
        op1_language_id, op2_packing, op3_near_dedup, op4_mixing, op5_line_dedup, op6_embedding_dedup, op7_token_counts,
        op8_top_k, op9_quality, op10_licenses, op11_whitening, op12_toxicity, op13_hard_negatives,
    )
}

ORACLES: dict[str, str] = {
    "op4_mixing": MIX_SQL,
    "op5_line_dedup": LINES_SQL,
    "op8_top_k": TOP_K_SQL,
    "op10_licenses": LICENSE_SQL,
    "op13_hard_negatives": HARD_NEGATIVES_SQL,
}
