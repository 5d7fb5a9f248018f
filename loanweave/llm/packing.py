"""Packing by shortest-pack-first over the length histogram.

Documents are tokenised once and cut into pieces of a whole sequence and one remainder. Only the histogram of piece
lengths (at most ``seq_len`` entries) decides how lengths share a sequence: lengths are placed longest first, each time
into the emptiest pattern that still has room, and only pattern *counts* are kept. Pieces then find their place by
their rank among the pieces of the same length.

Edge cases: a null or empty text has the end id alone; a null ``doc_id`` is packed like any other; repeated rows are
packed once each; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, saved

SEQ_LEN = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
CACHE = 600_000  # pre-tokens whose ids a worker remembers

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"

# Letters whose lower-casing and normal form concern one character alone; with ASCII they make a "plain" text.
_LETTERS = "a-zß-öø-įı-ž"
_PLAIN = re.compile("[\\t\\n\\r -~À-ÖØ-öø-įı-ž]*")
# The pre-tokens of the vocabulary's own pattern (a fixed value of the file), for a plain lower-case text.
_PRE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")
_SPLIT = re.compile("[ \\n]+")


class _Ids(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, model, alphabet):
        self.model, self.alphabet = model, alphabet

    def __missing__(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else self.alphabet(piece)[0][0]
        ids = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped))
        if len(self) < CACHE:
            self[piece] = ids
        return ids


class Encoder:
    """Ids of a text, equal to the tokenizer's own, with the merges of each distinct pre-token done once.

    The vocabulary drops white space, so words can be encoded one by one. A text of plain letters is cut into
    pre-tokens here; any word with another character goes through the tokenizer itself.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(file)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.ids = _Ids(self.tokenizer.model, level.pre_tokenize_str)

    def _odd(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.ids.__getitem__, _PRE.findall(text.lower())))

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return self._plain(text)
        words = _SPLIT.split(text)
        plain = lambda w: _PLAIN.fullmatch(w) and "<|" not in w  # noqa: E731  special tokens' names are special
        return b"".join(self._plain(w) if plain(w) else self._odd(w) for w in words if w)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, seq_len: int = SEQ_LEN, tokenizer: str | None = None) -> DataFrame:
    """Cut each document's ids, with the end id, into pieces of ``seq_len`` and a remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer or tokenizer_path())
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            rows = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder(text.as_py()) + end
                n = len(ids) // 4
                for start in range(0, n, seq_len):
                    part = ids[4 * start : 4 * (start + seq_len)]
                    for column, value in zip(rows, (doc_id, start, len(part) // 4, zlib.crc32(part), n)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, PIECES)


def patterns(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, number of such sequences), by shortest-pack-first.

    Each step uses up a length or a pattern that is still open, so both the steps and the patterns number at most
    about twice the distinct lengths, whatever the counts.
    """
    open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    closed: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], count: int) -> None:
        room = seq_len - sum(pattern)
        (open_by_room[room] if room else closed).append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, held in open_by_room.items() if held and r >= length), default=None)
            if room is None:
                put((length,), left)
                break
            pattern, count = open_by_room[room].pop()
            used = min(left, count)
            if count > used:
                open_by_room[room].append((pattern, count - used))
            put((*pattern, length), used)
            left -= used
    return closed + [entry for room in sorted(open_by_room) for entry in open_by_room[room]]


def slots(chosen: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): which ranks of a length fill which place."""
    taken: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for lengths, count in chosen:
        offset = 0
        for length in lengths:
            out.append((length, taken[length], count, sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    return out


def ranked(table: DataFrame, histogram: dict[int, int], per_bucket: int = 2000) -> DataFrame:
    """Append ``rank``, 0-based and gapless among the pieces of one length.

    A frequent length is never ranked by one task: its pieces are dealt over hash buckets, as many as its count asks for,
    ranked in each, and shifted by the running count of the buckets before. ``histogram`` has at most as many lengths as a
    sequence has tokens.
    """
    sizes = table.sparkSession.createDataFrame(
        [(length, buckets_for(n, per_bucket)) for length, n in histogram.items()], "length bigint, buckets bigint"
    )
    dealt = table.join(sizes, "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.col("buckets"))).drop("buckets")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("m"))
    shifts = counts.select("length", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    return (
        dealt.withColumn("inside", F.row_number().over(inside) - 1)
        .join(shifts, ["length", "bucket"])
        .withColumn("rank", F.col("shift") + F.col("inside"))
        .drop("bucket", "inside", "shift")
    )


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, tokenizer: str | None = None) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; the pieces of a sequence lie without gaps from 0.

    The slot table has at most ``seq_len`` lengths times the patterns that hold them, which depends on ``seq_len``
    alone; a piece looks through the ranges of its length for the one that holds its rank.
    """
    table = saved(pieces(docs, seq_len, tokenizer), "pieces")
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    spark = docs.sparkSession
    places = spark.createDataFrame(
        slots(patterns(histogram, seq_len)), "length bigint, low bigint, ranks bigint, sequence bigint, offset bigint"
    )
    by_length = places.groupBy("length").agg(
        F.array_sort(F.collect_list(F.struct("low", "ranks", "sequence", "offset"))).alias("places")
    )
    at = F.col("place")
    holds = lambda p: (p["low"] <= F.col("rank")) & (F.col("rank") < p["low"] + p["ranks"])
    return (
        ranked(table, histogram)
        .join(by_length, "length")
        .withColumn("place", F.get(F.filter("places", holds), F.lit(0)))
        .select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens",
            (at["sequence"] + F.col("rank") - at["low"]).alias("sequence_id"), at["offset"].alias("offset"),
        )
    )
