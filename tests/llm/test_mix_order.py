"""The words of the mix come from the placed uses of the training order."""

import hashlib
import re
from collections import defaultdict

import pytest

from loanweave.llm import mixing, queries
from loanweave.llm.mixing import SCHEDULES, curriculum, mix

from ..conftest import SF
from .test_mixing import wanted


def due(part, schedule):
    """The time by which ``part`` of the demand has come, by bisection of the integral."""
    steps = len(schedule) - 1
    area = lambda x: sum(
        a * u + (b - a) * u * u / 2
        for i, (a, b) in enumerate(zip(schedule, schedule[1:]))
        for u in [min(max(x - i, 0), 1)]
    )
    low, high = 0.0, float(steps)
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if area(middle) < part * area(steps) else (low, middle)
    return low / steps


def brute(rows):
    """(doc_id, source) -> list of (use, words, position)."""
    size = {(r[0], r[3]): len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    of = defaultdict(list)
    for key in sorted(size, key=lambda k: hashlib.md5(f"{k[0]}-mix".encode()).hexdigest()):
        of[key[1]].append(key)
    targets = wanted({s: sum(size[k] for k in keys) for s, keys in of.items()})
    placed = {k: [] for k in size}
    for place, source in enumerate(targets):
        left, done, use = int(targets[source]), 0, 0
        while left > 0 and sum(size[k] for k in of[source]):
            for k in of[source]:
                if left > 0 and size[k]:
                    part = min(done / max(targets[source], 1.0), 1.0)
                    placed[k].append((use, min(left, size[k]), due(part, SCHEDULES[place % len(SCHEDULES)])))
                    left, done = left - size[k], done + size[k]
            use += 1
    return size, placed


ROWS = [(i, "w " * (i * 7 % 13), None, s) for i, s in enumerate(["a"] * 40 + ["b"] * 5 + ["c"] * 20 + [None] * 9)]


def test_mix_and_curriculum_equal_brute_force(documents):
    size, placed = brute(ROWS)
    for r in mix(documents(ROWS)).collect():
        uses = placed[r["doc_id"], r["source"]]
        assert (r["size"], r["taken"], r["uses"]) == (size[r["doc_id"], r["source"]], sum(u[1] for u in uses), len(uses))
        assert r["first_position"] == (pytest.approx(uses[0][2], abs=1e-9) if uses else None)
    got = curriculum(documents(ROWS), whole=False).collect()
    assert len(got) == sum(map(len, placed.values()))
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    for r in got:
        _, words, position = placed[r["doc_id"], r["source"]][r["use"]]
        assert r["words"] == words
        assert r["position"] == pytest.approx(position, abs=1e-9)


def test_rows_of_one_id_are_summed_apart(documents):
    rows = [(1, "a b c", None, "s"), (1, "a b c", None, "s"), (None, "d e", None, "s"), (None, "d e", None, "s"), (2, "", None, "s")]
    got = mix(documents(rows)).collect()
    assert len(got) == 5
    assert sum(r["taken"] for r in got) == 15
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_registered_query_builds_the_order(spark, monkeypatch):
    written = {}
    save = mixing.saved
    monkeypatch.setattr(mixing, "saved", lambda df, name: written.setdefault(name, save(df, name)), raising=False)
    rows = queries.op4_mixing(spark, SF).collect()
    order = written["mix-order"].collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order)
    assert sum(r["words"] for r in order) == sum(r["taken"] for r in rows) > 0
