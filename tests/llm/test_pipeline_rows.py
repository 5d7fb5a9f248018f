"""The rows of the pipeline's stages against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from loanweave.llm.mixing import SCHEDULES
from loanweave.llm.packing import END_ID, Encoder, tokenizer_path

from ..conftest import SF
from .test_linededup import brute as lines_brute
from .test_mix_order import due
from .test_mixing import wanted


def shingle_set(text):
    words = (text or "").lower().split()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def near_dedup_brute(rows):
    """Rows (doc_id, text) that stay: the least one of each group, every one without words."""
    group = list(range(len(rows)))
    sets = [shingle_set(r[1]) for r in rows]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) * 100 >= len(a | b) * 75:
                group = [group[j] if g == group[i] else g for g in group]
    order = lambda r: (r[0] is None, r[0] or 0)
    best = {}
    for r, g in zip(rows, group):
        best[g] = min(best.get(g, r), r, key=order)
    return sorted(best.values(), key=lambda r: (order(r), r[1] or ""))


def text(first, n=40):
    return " ".join(f"w{first + i}" for i in range(n))


ROWS = [
    (1, text(0)), (1, text(100)),  # two texts under one id
    (2, text(0) + " more"), (2, text(200)),  # a near copy under the id of a row that is kept
    (None, text(300)), (None, text(300)), (None, text(300) + " end"), (None, text(400)),  # copies without an id
    (5, text(400)), (6, text(500)), (7, text(500)), (7, text(500)), (8, ""), (None, None), (9, "few words"),
]


def test_near_dedup_of_repeated_and_null_ids(spark, documents):
    kept = corpus_pipeline.near_dedup(spark, documents(ROWS).repartition(3), SF).collect()
    got = sorted(((r["doc_id"], r["text"]) for r in kept), key=lambda r: ((r[0] is None, r[0] or 0), r[1] or ""))
    assert got == near_dedup_brute(ROWS)


def mix_brute(rows):
    """(doc_id, text) of every use, in training order."""
    by_source = defaultdict(list)
    for doc_id, body, source in sorted(rows, key=lambda r: hashlib.md5(f"{r[0]}-mix".encode()).hexdigest()):
        by_source[source].append((doc_id, body, len(re.findall(r"[^\x20\x09-\x0D]+", body or ""))))
    targets, order = wanted({s: sum(d[2] for d in docs) for s, docs in by_source.items()}), []
    for place, (source, target) in enumerate(targets.items()):
        whole, before = sum(d[2] for d in by_source[source]), 0
        rounds = int(target) // whole if whole else 0
        for doc_id, body, size in by_source[source]:
            left = int(target) - rounds * whole - before
            for use in range(rounds + (left * 2 > size) if size else 0):
                part = min((use * whole + before) / max(target, 1.0), 1.0)
                order.append((due(part, SCHEDULES[place % len(SCHEDULES)]), doc_id, use, body))
            before += size
    return [(doc_id, body) for _, doc_id, _, body in sorted(order)]


def corpus():
    rng = random.Random(12)
    words = {"en": "the of house and river old there where water stone".split(), "de": "das und haus fluss alt dort wo wasser stein ist".split()}
    shared = "this line of the footer is on very many pages"
    rows = []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        body = "\n".join(" ".join(rng.choices(words[lang], k=rng.randrange(4, 15))) for _ in range(rng.randrange(1, 6)))
        rows.append((i, body + (f"\n  {shared.upper()} " if i % 4 == 0 else ""), lang, ("a", "b", None)[i % 3]))
    rows += [(200 + i, rows[i][1] + " end", rows[i][2], "b") for i in range(0, 40, 3)]
    rows += [(300, "", "en", "a"), (301, None, "en", "a"), (302, "12 34 !!", "en", "b"), (303, "1 2 3", None, None)]
    return rows


def test_every_stage_and_run_equal_plain_python(spark, documents, tmp_path):
    documents(corpus()).write.parquet(str(tmp_path / "documents.parquet"))
    sf_dir, stages = str(tmp_path), dict(corpus_pipeline.STAGES)
    docs = corpus_pipeline.saved(stages["language_id"](spark, corpus_pipeline.read(spark, sf_dir, "documents"), sf_dir), "test")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert {r[0] for r in rows} >= set(range(120)) and not {300, 301, 302, 303} & {r[0] for r in rows}

    def collected(name):
        nonlocal docs
        docs = corpus_pipeline.saved(stages[name](spark, docs, sf_dir), "test")
        return [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]

    source = {r[0]: r[2] for r in rows}
    expected = sorted((d, kept, source[d]) for d, kept, _, _ in lines_brute([r[:2] for r in rows]))
    rows = collected("line_dedup")
    assert sorted(rows, key=lambda r: r[0]) == expected
    expected = near_dedup_brute([r[:2] for r in rows])
    rows = collected("near_dedup")
    assert sorted(r[:2] for r in rows) == sorted(expected) and len(rows) < len(source)
    assert all(source[r[0]] == r[2] for r in rows)

    order = mix_brute(rows)
    docs = stages["mix_sources"](spark, docs, sf_dir)
    assert [(r["doc_id"], r["text"]) for r in docs.collect()] == order

    encoder, pieces = Encoder(tokenizer_path()), Counter()
    for doc_id, body in order:
        ids = encoder(body) + END_ID.to_bytes(4, "little")
        for start in range(0, len(ids) // 4, 2048):
            part = ids[4 * start : 4 * start + 8192]
            pieces[(doc_id, start, len(part) // 4, zlib.crc32(part), len(ids) // 4)] += 1
    for packed in (stages["pack"](spark, docs, sf_dir), corpus_pipeline.run(spark, sf_dir)):
        found = packed.collect()
        assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == pieces
        filled = defaultdict(list)
        for r in found:
            filled[r["sequence_id"]].append((r["offset"], r["length"]))
        assert all(sum(n for _, n in held) <= 2048 for held in filled.values())
        assert all(a + n == b for held in filled.values() for (a, n), (b, _) in zip(sorted(held), sorted(held)[1:]))
