import hashlib
import time
from collections import defaultdict

import numpy as np
import pytest

from loanweave.llm import linededup
from loanweave.llm.linededup import CuckooFilter, LineIndex, dedup_lines, digest, line_key, plain_key

SPACE = " \t\n\x0b\x0c\r"


def lowered(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows):
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(lowered(line)) >= 20:
                holders[lowered(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        all_lines = (text or "").split("\n")
        kept = [
            x for x in all_lines
            if doc_id is None or len(holders[lowered(x)]) < 3 or doc_id == max(holders[lowered(x)])
        ]
        out.append((doc_id, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["kept"], r["n_lines"], r["n_dropped"]) for r in df.collect()), key=str)


LONG = "a line of more than twenty letters"
ROWS = [
    (1, f"{LONG}\nown text\n{LONG}"), (2, f"  {LONG.upper()}\t\nx"), (3, f"{LONG}\n{LONG}"), (4, "short\nshort"),
    (5, "short"), (6, "short"), (7, None), (8, ""), (None, LONG), (9, "Ünder twenty änd more letters"),
    (10, "ünder twenty änd more letters"), (11, "Ünder twenty änd more letters"), (12, "Ünder twenty änd more letters"),
    (2, f"{LONG}\nsecond row of 2"), (13, "nineteen letters ab"), (14, "nineteen letters ab"), (15, "nineteen letters ab"),
]


def test_equals_brute_force(documents):
    assert got(dedup_lines(documents(ROWS))) == brute(ROWS)


def test_hot_line(documents):
    rows = [(i, f"{LONG}\nrow {i} has its own twenty letters") for i in range(2000)]
    assert got(dedup_lines(documents(rows))) == brute(rows)


def test_insert_then_delete_restores(documents):
    first, second = ROWS[:9], ROWS[9:]
    index = LineIndex.build(documents(first))
    grown = index.insert(documents(second))
    assert got(grown.apply(documents(ROWS))) == brute(ROWS)
    ids = documents([(r[0], None) for r in second if r[0] not in {x[0] for x in first}])
    shrunk = grown.delete(ids.select("doc_id"))
    rest = [r for r in ROWS if r[0] is None or r[0] <= 8]
    assert got(shrunk.apply(documents(rest))) == brute(rest)


def test_a_change_touches_only_its_keys_and_shards(documents):
    rows = [(i, f"{LONG}\n{LONG} no {i % 40}\nown line of document {i}, of some length") for i in range(100)]
    index = LineIndex.build(documents(rows))
    new = f"{LONG} no 3\nown line of document 5, of some length\na line that nobody else has, for now"
    grown = index.insert(documents([(500, new)]))
    assert grown.changes[:-1] == index.changes and grown.changes[-1].count() == 3
    assert grown.count_parts[:-1] == index.count_parts and grown.count_parts[-1].count() == 3
    # One line was over the threshold already, the other two stay below it.
    assert grown.filter_parts[:-1] == index.filter_parts and grown.filter_parts[-1].count() == 0
    more = grown.insert(documents([(501, "own line of document 5, of some length")]))
    assert more.changes[-1].count() == 1 and more.filter_parts[-1].count() == 1
    every = [*rows, (500, new), (501, "own line of document 5, of some length")]
    assert got(more.apply(documents(every))) == brute(every)

    again = more.insert(documents([(501, "own line of document 5, of some length")]))
    assert again.changes[-1].count() == 0 and again.count_parts[-1].count() == 0
    back = again.delete(documents([(500, None), (501, None), (777, None)]))
    show = lambda df: sorted(map(str, df.collect()))
    assert show(back.table) == show(index.table) and show(back.counts) == show(index.counts)
    held = lambda i: {r["shard"]: (sorted(x for row in CuckooFilter.load(bytes(r["filter"])).table for x in row if x), r["n"]) for r in i.filters.collect()}  # noqa: E731,E501
    assert held(back) == held(index)
    assert got(back.apply(documents(rows))) == brute(rows)


def test_many_changes_are_merged_and_shards_grow(documents, monkeypatch):
    monkeypatch.setattr(linededup, "MOST_PARTS", 3)
    monkeypatch.setattr(linededup, "KEYS_PER_SHARD", 4)
    rows = [(i, f"{LONG} no {i % 5}") for i in range(15)]
    index, so_far = LineIndex.build(documents(rows)), list(rows)
    for step in range(4):
        more = [(100 * step + 100 + i, "\n".join(f"{LONG} {step}-{j}" for j in range(60))) for i in range(3)]
        index, so_far = index.insert(documents(more)), so_far + more
        assert got(index.apply(documents(so_far))) == brute(so_far)
    assert len(index.changes) <= 3 and index.shards > linededup.SHARDS


def test_odd_and_empty_tables(odd_documents, documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert got(dedup_lines(odd_documents)) == brute(rows)
    assert dedup_lines(documents([])).count() == 0


def test_clashing_names(documents):
    extra = ("keys", "of", "at", "row", "cut", "key", "line", "shard", "part", "filter", "n_docs", "last_doc", "_doc", "a.b")
    df = documents(ROWS).selectExpr("*", *[f"'{c}' AS `{c}`" for c in extra], "7 AS kept", "8 AS n_lines")
    found = dedup_lines(df)
    assert got(found) == brute(ROWS)
    assert all(found.filter(f"`{c}` <> '{c}' or `{c}` is null").isEmpty() for c in extra)


def test_very_many_lines_in_one_document(documents):
    lines = [f"line {i} of more than twenty letters" for i in range(100_000)]
    text = "\n".join(lines)
    rows = [(1, text + "\nonly here, more than twenty letters"), (2, text), (3, text)]
    start = time.perf_counter()
    found = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in dedup_lines(documents(rows)).collect()}
    assert found[1] == (100_001, 100_000, "only here, more than twenty letters")
    assert found[2] == (100_000, 100_000, "") and found[3] == (100_000, 0, text)
    assert time.perf_counter() - start < 120


def test_worker_and_column_agree_on_keys(spark):
    odd = ["  ÄÖÜ Abc\u00a0 ", "\x0b\x0cTabs\t", "", "İ I ı", "漢字 ABC", "\x1f x \x1c"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(odd)], "i int, s string")
    keys = {r["i"]: bytes(r["k"]) for r in df.select("i", digest(line_key(df["s"])).alias("k")).collect()}
    assert [keys[i] for i in range(len(odd))] == [plain_key(s) for s in odd]


def test_filter_has_no_false_negative_and_deletes():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(5000)]
    held = CuckooFilter.of(keys)
    assert held.contains(keys).all()
    others = [hashlib.md5(f"o{i}".encode()).digest() for i in range(5000)]
    assert held.contains(others).mean() < 0.01
    for key in keys[:2500]:
        assert held.delete(key)
    assert held.contains(keys[2500:]).all()
    assert held.contains(keys[:2500]).mean() < 0.02
    assert np.array_equal(CuckooFilter.load(held.dump()).table, held.table)
