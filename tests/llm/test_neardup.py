import random

import numpy as np

from loanweave.llm.common import components
from loanweave.llm.neardup import COORDINATES, MATCHES, Signer, near_duplicates, shingles


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    ids = [r[0] for r in rows]
    sets = [sets_of(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(ids[i])
    least = {k: min((v for v in g if v is not None), default=None) for k, g in groups.items()}
    return sorted(((ids[i], len(sets[i]), least[find(i)]) for i in range(len(rows))), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def corpus(seed, bases, copies, share):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(bases):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(3, 150))]
        for _ in range(copies):
            text = list(base)
            for _ in range(int(len(text) * rng.random() * share)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            rows.append((n, " ".join(text)))
            n += 1
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(documents):
    rows = corpus(1, 25, 6, 0.08)
    assert got(near_duplicates(documents(rows))) == brute(rows)


def test_group_of_graded_copies(documents):
    """Copies around the threshold, so that most of the group hangs together only through some of its members."""
    rows = corpus(2, 1, 120, 0.12) + [(1000 + i, t) for i, (_, t) in enumerate(corpus(3, 10, 1, 0))]
    assert got(near_duplicates(documents(rows))) == brute(rows)


def test_shared_passage_is_no_link(documents):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(60)) + " " + passage) for i in range(80)]
    assert got(near_duplicates(documents(rows))) == brute(rows)


def test_odd_and_empty_tables(odd_documents, documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert got(near_duplicates(odd_documents)) == brute(rows)
    assert near_duplicates(documents([])).count() == 0


def test_signature_estimates_similarity():
    signer, rng = Signer(COORDINATES, 5), np.random.default_rng(3)
    agree = []
    for _ in range(200):
        x = rng.integers(0, 2**63, 700, np.uint64)
        agree.append((signer(x[:600]) == signer(np.concatenate((x[:500], x[600:])))).sum())  # 500 of 700
    assert abs(np.mean(agree) / COORDINATES - 5 / 7) < 0.02
    assert min(agree) >= MATCHES - 4
    assert len(shingles("A b\tc D\x0be")) == 1 and (shingles("a B") == shingles("A  b")).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (9, 3)], "a bigint, b bigint")
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    assert roots == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}}
