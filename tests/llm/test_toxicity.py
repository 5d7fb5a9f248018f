"""Toxicity: held-out quality, shared subwords, the gradient, and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from loanweave.llm import toxicity

DOC = "doc_id bigint, text string"
LABEL = "doc_id bigint, toxic int"
PLAIN = [f"{a}{b}{c}" for a in ("mel", "tor", "ban", "sil") for b in ("a", "o", "i") for c in ("ran", "lek", "dun", "vis", "pom")]


def texts(n, seed, bad=("wretchling", "grubface", "scumbag")):
    """(text, label): every third has one or two bad words somewhere in it."""
    rng, out = random.Random(seed), []
    for i in range(n):
        words = rng.choices(PLAIN, k=rng.randrange(5, 80))
        if i % 3 == 0:
            for _ in range(rng.randrange(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        out.append((" ".join(words), int(i % 3 == 0)))
    return out


@pytest.fixture(scope="module")
def model():
    rows = texts(400, 1)
    return toxicity.train([t for t, _ in rows], [y for _, y in rows])


def test_finds_few_words_in_long_texts(model):
    score = toxicity.Scorer(model)
    rows = texts(200, 2)
    assert all((score(t) >= toxicity.CUT) == bool(y) for t, y in rows)
    clean = " ".join(random.Random(3).choices(PLAIN, k=2000))
    assert score(clean) < toxicity.CUT < score(clean + " grubface scumbag wretchling")


def test_unseen_misspellings_share_vectors(model):
    score = toxicity.Scorer(model)
    plain = " ".join(PLAIN[:12])
    for word in ("wretchlings", "grubfaces", "xscumbag", "grubfacee"):
        assert score(plain + " " + word) >= toxicity.CUT
    assert score(plain + " harmless") < toxicity.CUT


def test_a_score_is_the_pooled_average_of_windows():
    held = toxicity.bags(["melaran bad bad torolek sila", "melaran bad bad torolek sila"])
    rng = np.random.default_rng(0)
    z = rng.normal(size=toxicity.BUCKETS)

    def pooled(z):
        size = np.diff(held.word_start)
        per_word = toxicity.segment_sums(z[held.subword], held.word_start)
        n = toxicity.segment_sums(size[held.word], held.window_start)
        return toxicity.log_mean_exp(toxicity.segment_sums(per_word[held.word], held.window_start) / n, held.document_start)[0]

    learnt = np.zeros(toxicity.BUCKETS, bool)
    learnt[held.subword] = True
    odds = toxicity.Model(z[:, None], np.array([[-0.5, 0.5]]), np.zeros(2), learnt)
    got = toxicity.Scorer(odds)("melaran bad bad torolek sila")
    assert got == pytest.approx(1 / (1 + np.exp(-pooled(z))))


def test_pieces_do_not_change_a_score(model, monkeypatch):
    text = " ".join(random.Random(4).choices(PLAIN, k=1001)) + " grubface " + "y" * 500
    whole = toxicity.Scorer(model)(text)
    monkeypatch.setattr(toxicity, "_AT_ONCE", 8)
    monkeypatch.setattr(toxicity, "_CACHED", 5)
    assert toxicity.Scorer(model)(text) == pytest.approx(whole, rel=1e-12)


def test_held_out_labels_and_rerun(spark):
    """The labels that were not learnt from, in a table of ten thousand documents."""
    sf = "/root/testdata/sf0.1"
    rows = contract.queries()["op12_toxicity"](spark, sf).cache()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows.count() == docs.count() and rows.filter("not score between 0 and 1 or (predicted = 1) <> (score >= 0.5)").isEmpty()
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    held = rows.filter("held_out").join(labels, "doc_id").filter("toxic is not null")
    n, caught, toxic, wrong = held.agg(
        *[F.expr(f"count_if({e})") for e in ("true", "toxic = 1 and predicted = 1", "toxic = 1", "toxic = 0 and predicted = 1")]
    ).first()
    assert toxic > 40 and caught / toxic >= 0.9 and wrong / (n - toxic) <= 0.01


def test_held_out_rows_are_not_learnt_from(spark, monkeypatch):
    rows = [(i, t, y) for i, (t, y) in enumerate(texts(60, 5))]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], DOC), spark.createDataFrame([(r[0], r[2]) for r in rows], LABEL)
    held = {r["doc_id"] for r in docs.select("doc_id", toxicity.fold(F.col("doc_id")).alias("f")).filter("f = 0").collect()}
    got = {r["text"] for r in toxicity.sample(docs, labels).collect()}
    assert got == {t for i, t, _ in rows if i not in held}
    bounded = toxicity.sample(docs, labels, {0: 5, 1: 4}).collect()
    assert sorted(r["label"] for r in bounded) == [0] * 5 + [1] * 4


def test_the_sample_is_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)], DOC)
    labels = spark.createDataFrame([(1, 1)] * 20, LABEL)
    assert toxicity.sample(docs, labels, {0: 3, 1: 3}).count() <= 6


def test_odd_documents(spark, odd_documents):
    labels = spark.createDataFrame([(4, 1), (5, 0), (1, 1), (None, 1), (3, 0), (7, None), (8, 7)], LABEL)
    rows = toxicity.score(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b"), (3, None)], DOC)
    none = spark.createDataFrame([], LABEL)
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(spark.createDataFrame([], DOC), none).count() == 0
