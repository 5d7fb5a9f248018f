import zlib
from collections import Counter

import pytest

from loanweave.llm.packing import END_ID, Encoder, pack, patterns, slots, tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path())


@pytest.mark.parametrize(
    "text",
    ["", " ", "Hello, world's END...", "don't we'll I'M 'tis ''s", "a1b22 3.14", "naïve Straße ÀÉÎ œuvre ÿ × ÷ ǆ",
     "İstanbul ΣΑΣ ς", "漢字 🙂 é   x y \x1cz", "<|endoftext|> <|startoftext|>a <| b |>", "tab\tnew\r\nline\x0bvt"],
)
def test_ids_are_the_tokenizers_own(encoder, text):
    from tokenizers import Tokenizer

    expected = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert encoder(text) == b"".join(i.to_bytes(4, "little") for i in expected)


def test_patterns_use_every_length_once():
    histogram = {2048: 3, 1500: 7, 700: 2, 548: 9, 30: 100, 1: 4}
    chosen = patterns(histogram)
    used = Counter()
    for lengths, count in chosen:
        assert sum(lengths) <= 2048 and count > 0
        for length in lengths:
            used[length] += count
    assert used == histogram
    assert len(chosen) <= 2 * len(histogram)
    ranges = sorted((length, low, low + n) for length, low, n, _, _ in slots(chosen))
    for (a, _, end), (b, low, _) in zip(ranges, ranges[1:]):
        assert low == (end if a == b else 0)


def test_pieces_and_places(spark, odd_documents, encoder):
    rows = pack(odd_documents, seq_len=512).collect()
    docs = Counter((r["doc_id"], r["text"]) for r in odd_documents.collect())
    expected = Counter()
    for (doc_id, text), times in docs.items():
        ids = encoder(text) + END_ID.to_bytes(4, "little")
        for start in range(0, len(ids) // 4, 512):
            part = ids[4 * start : 4 * start + 2048]
            expected[(doc_id, start, len(part) // 4, zlib.crc32(part), len(ids) // 4)] += times
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == expected
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 512
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_empty_table(documents):
    assert pack(documents([])).count() == 0


def test_one_hot_length_is_packed_whole(spark, documents):
    rows = pack(documents([(i, "same words here") for i in range(3000)]), seq_len=64).collect()
    assert len(rows) == 3000
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3000
