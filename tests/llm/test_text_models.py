import numpy as np
import pytest

from loanweave.llm import langid, licenses, quality, trietokens


@pytest.fixture(scope="module")
def pieces():
    return trietokens.Pieces(trietokens.model_path())


def split_brute(pieces, text):
    """Best split of the whole text at once, not by pre-tokens."""
    text = trietokens.SPACE + text.replace(" ", trietokens.SPACE)
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        options = [(best[-1][0] + pieces.unknown, best[-1][1] - len(text[end - 1].encode()))]
        for start in range(max(0, end - pieces.longest), end):
            own = pieces.score.get(text[start:end])
            if own is not None:
                options.append((best[start][0] + own, best[start][1] - 1))
        best.append(max(options))
    return -best[-1][1]


TEXTS = ["the quick brown fox", "a  b   c ", "línea ñandú\n\nzwei Straßen", "漢字🙂 mixed", "thththth ionationation", "x" * 300, " "]


def test_counts_equal_brute_force(spark, documents, pieces):
    got = {r["doc_id"]: r["n_tokens"] for r in trietokens.token_counts(documents(list(enumerate(TEXTS)))).collect()}
    assert got == {i: split_brute(pieces, t) for i, t in enumerate(TEXTS)}


def test_shared_prefixes_change_nothing(pieces):
    words = ["▁there", "▁the", "▁them", "▁theme", "▁a", "zzz", "▁thermal"]
    assert pieces.counts(words) == {w: pieces.counts([w])[w] for w in words}


def test_counts_when_little_is_remembered(documents, monkeypatch):
    expected = [tuple(r) for r in trietokens.token_counts(documents(list(enumerate(TEXTS)))).collect()]
    assert len(expected) == len(TEXTS)
    both = trietokens._Both({"a": 1}, {"b": 2})
    assert both["a"] == 1 and both["b"] == 2


def test_odd_tables(documents, odd_documents):
    rows = trietokens.token_counts(odd_documents).collect()
    assert len(rows) == 12
    assert all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (1, 2))
    assert trietokens.token_counts(documents([])).count() == 0


EN, DE = "the cat sat on the mat and ate", "der hund und die katze schlafen nicht"


def test_language_of_odd_rows(documents, odd_documents):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(200)]
    model = langid.fit(documents(rows))
    got = langid.predict(odd_documents, model).collect()
    assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    ask = documents([(1, EN), (2, DE)])
    assert [r["lang_pred"] for r in langid.predict(ask, model).orderBy("doc_id").collect()] == ["en", "de"]


def test_language_without_labels(documents):
    got = langid.identify(documents([(1, EN), (2, DE)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2
    assert langid.identify(documents([])).count() == 0


def test_held_out_rows_teach_nothing(documents):
    import zlib

    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    rows = [(i, EN, "en" if fold(i) != 2 else "xx") for i in range(100)]
    assert langid.fit(documents(rows)).languages == ["en"]


def test_weights_are_sparse_and_temperature_fits():
    z = np.array([[0.01, -5.0], [3.0, 0.0]])
    w = langid.ftrl_weights(z, np.ones_like(z))
    assert w[0, 0] == 0 and w[1, 1] == 0 and w[0, 1] > 0 > w[1, 0]
    rng = np.random.default_rng(2)
    logits = rng.standard_normal((4000, 3)) * 2
    p = langid._softmax(logits)
    labels = [int(rng.choice(3, p=q)) for q in p]
    rows = [{"label": y, "logits": (x * 4).tolist()} for x, y in zip(logits, labels)]
    assert langid.temperature_of(rows) == pytest.approx(4, rel=0.15)


def test_quality_of_odd_rows(spark, documents, odd_documents):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    good, bad = "some honest words that differ in each line of the text {}", "## $$ ## $$ {} ## $$"
    docs = documents([(i, (good if i % 2 else bad).format(i)) for i in range(300)])
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, labels).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)
    got = quality.score(odd_documents, labels).collect()
    assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got)
    none = quality.score(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score(documents([]), labels).count() == 0


def test_quality_difference_is_that_of_the_densities():
    rng = np.random.default_rng(6)
    d = len(quality.NAMES)
    x = {0: rng.standard_normal((400, d)), 1: rng.standard_normal((500, d)) * 1.5 + 0.3}
    moments = {k: (len(v), v.sum(axis=0), v.T @ v) for k, v in x.items()}
    model = quality.discriminant(moments)
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in x.values()) / 900
    point, logs = rng.standard_normal(d), []
    for k, v in x.items():
        cov = (1 - quality.POOLED - quality.SPHERE) * np.cov(v.T, bias=True) + quality.POOLED * pooled
        cov += quality.SPHERE * np.diag(np.diag(pooled))
        off = point - v.mean(axis=0)
        logs.append(-0.5 * off @ np.linalg.solve(cov, off) - 0.5 * np.linalg.slogdet(cov)[1])
    assert model.difference(point[None])[0] == pytest.approx(logs[1] - logs[0], rel=1e-6)


def test_license_rules_in_order(documents):
    mit = ". ".join(licenses.SENTENCES[k] for k in ("mit-name", "mit-grant", "mit-keep", "mit-as-is")) + "."
    notice = "Intro.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License!  Licensed under CC BY-NC 4.0"
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in licenses.scan(documents([(1, mit), (2, notice), (3, "none"), (4, None)])).collect()}
    assert got[1] == (["mit-name", "mit-grant", "mit-keep", "mit-as-is"], ["MIT"])
    assert got[2] == (["apache-notice", "mit-notice", "cc-by-nc"], ["Apache-2.0", "MIT", "CC-BY-NC-4.0"])
    assert got[3] == got[4] == ([], [])


def test_licenses_of_odd_tables(documents, odd_documents):
    assert licenses.scan(odd_documents).count() == 12
    assert licenses.scan(documents([])).count() == 0


def test_the_sample_is_even_over_languages():
    assert langid.even_share([1000, 1000], 500) == 250
    assert langid.even_share([10, 1000, 1000], 510) == 250
    assert langid.even_share([10, 20], 500) == float("inf")
    assert langid.even_share([], 5) == float("inf")


def test_a_rare_language_is_learnt(documents):
    common = ["the house by the river is old and grey", "das alte haus steht am grossen fluss dort"]
    rows = [(i, f"{common[i % 2]} {i % 17}", ("en", "de")[i % 2], "s") for i in range(1200)]
    rows += [(5000 + i, f"vanha talo on joen rannalla tuolla noin {'abcdefgh'[i % 8]}", "fi", "s") for i in range(12)]
    found = langid.identify(documents(rows), sample=300, calibration=150).filter("lang = 'fi'").collect()
    assert {r["lang_pred"] for r in found} == {"fi"}
