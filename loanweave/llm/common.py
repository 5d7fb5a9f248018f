"""What the operators share: tables, saved intermediates, folds, word counts and connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

# Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once, and a lost executor costs only the
    tasks that read it."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_row(columns: Sequence[str]) -> Column:
    """Input columns of any name as one struct, beside which an operator's own names cannot clash."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in columns])


def fold(doc_id: Column) -> Column:
    """Remainder 0..3 of the CRC-32 of the id's decimal text; null for a null id."""
    return (F.crc32(doc_id.cast("string")) % 4).cast("int")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def buckets_for(rows: int, per_bucket: int) -> int:
    """How many hash buckets to deal ``rows`` over so that one holds about ``per_bucket``, at any number of rows."""
    return max(1, -(-rows // per_bucket))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node id of each connected component, for nodes with an edge to another node.

    ``edges`` has bigint columns ``a`` and ``b``. Alternates two star operations until nothing changes: each node's
    larger neighbours, then its smaller ones and itself, are linked to the smallest node it knows. Both are one
    aggregation (combined before the shuffle, so a node with very many links is no hot spot) and one join. The edge
    list never grows, and each round is written to the shared folder. A graph of n nodes takes O(log n) rounds.
    """
    linked = edges.filter("a <> b")
    links = saved(linked.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = saved(small.unionByName(low.withColumnRenamed("m", "b")).filter("a <> b").distinct(), "edges")
        before, state = state, links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
    raise RuntimeError(f"components not settled after {rounds} rounds")
