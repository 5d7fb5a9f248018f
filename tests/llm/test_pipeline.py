import corpus_pipeline
from loanweave.llm.common import read

from ..conftest import SF


def test_stages(spark):
    docs = read(spark, SF, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, SF), f"test-{name}")
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        counts.append(docs.count())
    assert counts[0] == counts[1] == counts[2] > counts[3]
    uses = {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    assert set(uses.values()) <= {1, 2}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == len(uses)


def test_stages_of_odd_tables(spark, odd_documents, documents):
    for table, empty in ((odd_documents, False), (documents([]), True)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.saved(stage(spark, docs, SF), f"test-{name}")
        assert (docs.count() == 0) == empty


def test_near_dedup_keeps_one_of_repeated_rows(spark, documents):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "other words"), (None, "third")]
    kept = corpus_pipeline.near_dedup(spark, documents(rows), SF)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "third"), (1, "a b c d e f"), (3, "other words")]
