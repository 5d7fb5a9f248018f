"""Reversible line dedup: sharded cuckoo filters over exact reference tables.

The exact table holds one posting per distinct (line key, document). From it follow, per key, how many documents hold
it and which of them is the largest. A key held by ``min_docs`` documents or more is *flagged*. Each shard of keys has
a cuckoo filter of its flagged keys, which supports deletion; a document's lines are probed against the filters, and
only those that pass are joined to the exact table. Inserting or deleting documents appends the postings that come or go, recounts
their keys alone and, for the keys that cross the threshold, writes new filters of their shards; deleting what was inserted
restores both.

Edge cases: a null or empty text is one empty line; rows with a null ``doc_id`` hold nothing and keep all their lines;
rows that share a ``doc_id`` are one document when holders are counted; a document's lines are looked up by hash, however
many they are; an empty table gives an empty result; further columns, of any name, are kept untouched, but for those with
the name of a result column, which the result replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_row, buckets_for, saved

MIN_DOCS = 3
MIN_LENGTH = 20
SHARDS = 16
KEYS_PER_SHARD = 50_000
LINES_PER_GROUP = 50_000
MOST_PARTS = 16  # changes of an index until it is merged

# Fixed value: ASCII white space.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(UPPER, LOWER)

SLOTS = 4
KICKS = 500


class CuckooFilter:
    """Fingerprints of 16 bits, four to a bucket; each key has two buckets, either computable from the other."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        size = 1
        while size * SLOTS * 0.8 < len(keys):
            size *= 2
        while True:
            built = cls(np.zeros((size, SLOTS), np.uint16))
            if all(built.insert(k) for k in keys):
                return built
            size *= 2

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
        prints = (words[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1  # 0 marks a free slot
        first = (words[:, 0] & np.uint64(len(self.table) - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket, print_):
        return bucket ^ ((np.asarray(print_, np.int64) * 0x9E3779B1 >> 8) & (len(self.table) - 1))

    def contains(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        prints, first, second = self._places(keys)
        wanted = prints[:, None]
        return (self.table[first] == wanted).any(1) | (self.table[second] == wanted).any(1)

    def insert(self, key: bytes) -> bool:
        """False if the filter is too full; the caller then builds a larger one."""
        prints, first, second = self._places([key])
        mark, bucket = prints[0], int(first[0])
        for place in (bucket, int(second[0])):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return True
        for kick in range(KICKS):
            slot = kick % SLOTS
            mark, self.table[bucket, slot] = self.table[bucket, slot], mark
            bucket = int(self._other(bucket, mark))
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, key: bytes) -> bool:
        prints, first, second = self._places([key])
        for place in (int(first[0]), int(second[0])):
            held = np.flatnonzero(self.table[place] == prints[0])
            if len(held):
                self.table[place, held[0]] = 0
                return True
        return False


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def digest(key: Column) -> Column:
    return F.unhex(F.md5(key))


def postings(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Distinct (key, doc_id) of the lines that are long enough to count."""
    exploded = docs.filter("doc_id is not null").select("doc_id", F.explode(lines(F.col("text"))).alias("line"))
    keyed = exploded.select("doc_id", line_key(F.col("line")).alias("k"))
    return keyed.filter(F.char_length("k") >= min_length).select(digest(F.col("k")).alias("key"), "doc_id").distinct()


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


FILTER = "shard int, filter binary, n bigint"


def _built(keys: DataFrame, shards: int) -> DataFrame:
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        held = CuckooFilter.of(list(map(bytes, pdf["key"])))
        return pd.DataFrame({"shard": pdf["shard"][:1], "filter": [held.dump()], "n": [len(pdf)]})

    return keys.select("key", _shard(F.col("key"), shards).alias("shard")).groupBy("shard").applyInPandas(build, FILTER)


def _counts(table: DataFrame) -> DataFrame:
    return table.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def _latest(parts: Sequence[DataFrame], at: str) -> DataFrame:
    """The newest entry per ``at`` of tables of which a later one overrides an earlier one."""
    if len(parts) == 1:
        return parts[0]
    columns = parts[0].columns
    numbered = [p.withColumn("part_no", F.lit(i)) for i, p in enumerate(parts)]
    newest = reduce(DataFrame.unionByName, numbered).groupBy(at).agg(F.max_by(F.struct(*columns), "part_no").alias("e"))
    return newest.select("e.*")


@dataclass(frozen=True)
class LineIndex:
    """Postings and their counts per key (exact), and a filter of the flagged keys per shard.

    Each is a list of written tables. A change appends what it touches: postings with their sign, the new counts of their
    keys, the new filters of the shards with a key that crosses the threshold. Earlier tables are read, not written again;
    after ``MOST_PARTS`` changes they are merged.
    """

    changes: tuple[DataFrame, ...]
    count_parts: tuple[DataFrame, ...]
    filter_parts: tuple[DataFrame, ...]
    shards: int
    min_docs: int = MIN_DOCS
    min_length: int = MIN_LENGTH

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH) -> LineIndex:
        return cls._of(saved(postings(docs, min_length), "line-postings"), min_docs, min_length)

    @classmethod
    def _of(cls, table: DataFrame, min_docs: int, min_length: int) -> LineIndex:
        counts = saved(_counts(table), "line-counts")
        flagged = counts.filter(F.col("n_docs") >= min_docs)
        shards = max(SHARDS, buckets_for(flagged.count(), KEYS_PER_SHARD))
        filters = saved(_built(flagged.select("key"), shards), "line-filters")
        return cls((table.withColumn("sign", F.lit(1)),), (counts,), (filters,), shards, min_docs, min_length)

    @property
    def table(self) -> DataFrame:
        """(key, doc_id): the postings that hold."""
        return self._holding(self.changes)

    @property
    def counts(self) -> DataFrame:
        return _latest(self.count_parts, "key").filter("n_docs > 0")

    @property
    def filters(self) -> DataFrame:
        return _latest(self.filter_parts, "shard")

    def _holding(self, changes: Sequence[DataFrame]) -> DataFrame:
        if len(changes) == 1:
            return changes[0].select("key", "doc_id")
        signed = reduce(DataFrame.unionByName, changes).groupBy("key", "doc_id").agg(F.sum("sign").alias("n"))
        return signed.filter("n > 0").select("key", "doc_id")

    def _held_by(self, some: DataFrame, at: str) -> DataFrame:
        """The postings that hold for some keys or documents; no other ones are moved."""
        return self._holding([c.join(some, at, "left_semi") for c in self.changes])

    def _changed(self, change: DataFrame) -> LineIndex:
        """The index after the postings of ``change`` came (sign 1) or went (-1); each does change something."""
        change = saved(change, "line-postings")
        touched = change.select("key").distinct()
        now = replace(self, changes=(*self.changes, change))
        recounted = touched.join(_counts(now._held_by(touched, "key")), "key", "left")
        recounted = saved(recounted.select("key", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "last_doc"), "line-counts")
        flag = lambda n: F.coalesce(F.col(n) >= self.min_docs, F.lit(False))
        known = _latest([c.join(touched, "key", "left_semi") for c in self.count_parts], "key")
        both = recounted.join(known.select("key", F.col("n_docs").alias("n_before")), "key", "left")
        crossed = both.filter(flag("n_docs") != flag("n_before")).select(
            "key", flag("n_docs").alias("enters"), _shard(F.col("key"), self.shards).alias("shard")
        )
        filters = saved(self._updated(saved(crossed, "line-crossings")), "line-filters")
        now = replace(now, count_parts=(*self.count_parts, recounted), filter_parts=(*self.filter_parts, filters))
        # A filter that could not take all is built again; shards that have outgrown their size are dealt anew.
        overfull = filters.filter("filter is null").select("shard")
        if not filters.filter(F.col("n") > 2 * KEYS_PER_SHARD).isEmpty() or len(now.changes) > MOST_PARTS:
            return self._of(saved(now.table, "line-postings"), self.min_docs, self.min_length)
        if not overfull.isEmpty():
            flagged = now.counts.filter(F.col("n_docs") >= self.min_docs).withColumn("shard", _shard(F.col("key"), self.shards))
            rebuilt = _built(flagged.join(overfull, "shard", "left_semi").select("key"), self.shards)
            now = replace(now, filter_parts=(*now.filter_parts, saved(rebuilt, "line-filters")))
        return now

    def _updated(self, crossed: DataFrame) -> DataFrame:
        """The filters of the shards that have a key in ``crossed``."""

        def update(old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
            shard = int(change["shard"].iloc[0])
            held = CuckooFilter.load(old["filter"].iloc[0]) if len(old) else CuckooFilter.of([])
            enters = change["enters"].astype(bool)
            for key in map(bytes, change.loc[~enters, "key"]):
                held.delete(key)
            full = not all([held.insert(bytes(k)) for k in change.loc[enters, "key"]])
            n = (int(old["n"].iloc[0]) if len(old) else 0) + int(enters.sum()) - int((~enters).sum())
            return pd.DataFrame({"shard": [shard], "filter": [None if full else held.dump()], "n": [n]})

        own = self.filters.join(crossed.select("shard").distinct(), "shard", "left_semi")
        return own.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(update, FILTER)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with further documents; a line that a document of the same id already holds changes nothing."""
        new = postings(docs, self.min_length)
        held = self._held_by(new.select("key").distinct(), "key")
        return self._changed(new.join(held, ["key", "doc_id"], "left_anti").select("key", "doc_id", F.lit(1).alias("sign")))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index without some documents."""
        gone = self._held_by(doc_ids.select("doc_id").distinct(), "doc_id")
        return self._changed(gone.select("key", "doc_id", F.lit(-1).alias("sign")))

    def drops(self, held: DataFrame) -> DataFrame:
        """(doc_id, keys): the keys whose lines a document loses, among the postings ``held``."""
        parts = buckets_for(held.count() // self.shards, LINES_PER_GROUP)
        part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
        lines_ = held.withColumns({"shard": _shard(F.col("key"), self.shards), "part": part})
        copies = self.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

        def probe(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            if asked.empty or known.empty:
                return pd.DataFrame({"key": [], "doc_id": []})
            passed = CuckooFilter.load(known["filter"].iloc[0]).contains(list(map(bytes, asked["key"])))
            return asked.loc[passed, ["key", "doc_id"]]

        passed = (
            lines_.groupBy("shard", "part")
            .cogroup(copies.groupBy("shard", "part"))
            .applyInPandas(probe, "key binary, doc_id bigint")
        )
        exact = self.counts.filter(F.col("n_docs") >= self.min_docs)
        lost = passed.join(exact, "key").filter(F.col("doc_id") < F.col("last_doc"))
        return lost.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

    def apply(self, docs: DataFrame, held: DataFrame | None = None) -> DataFrame:
        """Documents with ``kept`` (the lines that stay, joined), ``n_lines`` and ``n_dropped``."""
        drops = self.drops(held if held is not None else postings(docs, self.min_length))
        # The input is one struct, so that no name of it can clash.
        rows = docs.select(as_row(docs.columns).alias("row"), F.col("doc_id").alias("at"))
        found = rows.join(drops.select(F.col("doc_id").alias("of"), "keys").hint("shuffle_hash"), F.col("at") == F.col("of"), "left")
        loses, text = F.col("keys").isNotNull(), F.col("row")["text"]
        cut = _without(F.when(loses, text), F.col("keys"))
        added = {
            "kept": F.when(loses, F.col("cut.kept")).otherwise(F.coalesce(text, F.lit(""))),
            "n_lines": F.size(lines(text)).cast("bigint"),
            "n_dropped": F.when(loses, F.col("cut.n_dropped")).otherwise(0).cast("bigint"),
        }
        kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in added]
        return found.select("row", "keys", cut.alias("cut")).select(*kept, *[v.alias(k) for k, v in added.items()])


def plain_key(line: str) -> bytes:
    """``digest(line_key(line))`` of a line that a worker holds."""
    return hashlib.md5(line.strip(SPACE).translate(_LOWERED).encode("utf-8", "surrogatepass")).digest()


@F.pandas_udf(T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_dropped", T.LongType())]))
def _without(text: pd.Series, keys: pd.Series) -> pd.DataFrame:
    """The text without the lines of the given keys, in time that grows with its lines; null where there is no text."""
    out = []
    for whole, lost in zip(text, keys):
        if whole is None or lost is None:
            out.append((None, None))
            continue
        known, all_lines = set(map(bytes, lost)), whole.split("\n")
        stays = [line for line in all_lines if plain_key(line) not in known]
        out.append(("\n".join(stays), len(all_lines) - len(stays)))
    return pd.DataFrame(out, columns=["kept", "n_dropped"]).astype({"n_dropped": "Int64"})


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH) -> DataFrame:
    """Index all documents, then drop from each what a later one also holds."""
    index = LineIndex.build(docs, min_docs, min_length)
    return index.apply(docs, index.table)
