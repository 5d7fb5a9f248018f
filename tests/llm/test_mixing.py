import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loanweave.llm.mixing import SCHEDULES, curriculum, due_time, mix


def wanted(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by the rule as it is worded: share out, cut, share the excess again."""
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(most * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if level * weight[s] > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= above


@pytest.mark.parametrize("counts", [{"a": 50, "b": 5, "c": 20}, {"a": 3, "b": 400, None: 9, "z": 1}, {"q": 7}, {None: 4}])
def test_targets_and_taken(documents, counts):
    rows = [(i * 10 + j, "w " * (i % 7 + 1), None, s) for j, (s, n) in enumerate(counts.items()) for i in range(n)]
    got = mix(documents(rows)).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
    expected, taken = wanted(dict(sizes)), defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(expected[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - expected[s]) <= 1 for s in expected)


def test_reruns_and_layouts_agree(documents):
    docs = documents([(i, "a b c " * (i % 5), None, f"s{i % 4}") for i in range(300)])
    key = lambda df: sorted((r["doc_id"], r["taken"]) for r in df.collect())
    assert key(mix(docs.repartition(7))) == key(mix(docs.repartition(2)))


def test_odd_rows(odd_documents):
    got = mix(odd_documents.drop("size")).collect()
    assert len(got) == 12
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)


def test_clashing_names(documents):
    rows = [(i, "w " * (i % 7 + 1), None, "ab"[i % 2]) for i in range(40)]
    extra = ("place", "before", "key", "name", "run", "row", "words", "stretch", "range", "goes", "wide", "turn", "given", "is_text",
             "twin1", "uid", "earlier", "inside", "text_hash", "weight", "limit", "level", "a.b", "_row", "_name", "_key")
    df = documents(rows).selectExpr("*", *[f"'{c}' AS `{c}`" for c in extra], "'mine' AS target", "'mine' AS source_size", "'mine' AS use", "map(doc_id, 1) AS m")
    plain, clashing = mix(documents(rows)), mix(df)
    columns = ["doc_id", "size", "source_size", "target", "taken", "uses", "first_position"]
    show = lambda d, c: sorted(map(tuple, d.select(*c).collect()))
    assert show(plain, columns) == show(clashing, columns)
    order = ["doc_id", "use", "position"]
    assert show(curriculum(documents(rows)), order) == show(curriculum(df), order)
    for found in (clashing, curriculum(df)):
        assert all(found.filter(f"`{c}` <> '{c}' or `{c}` is null").isEmpty() for c in extra)
    assert curriculum(df).filter("target <> 'mine'").isEmpty()


@pytest.mark.parametrize("ranges", [3, 40])
def test_a_hot_id_and_equal_rows_keep_their_uses(spark, documents, ranges):
    """A third of the rows share an id, and half of these are equal in all columns."""
    rows = [(i, "w " * (i % 5 + 1), None, "ab"[i % 2]) for i in range(120)]
    rows += [(7, "hot words of one id", None, "a")] * 30 + [(7, f"hot words {i}", None, "a") for i in range(30)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        order = curriculum(documents(rows)).collect()
        mixed = mix(documents(rows), whole=True).groupBy("doc_id", "text").agg(F.sum("uses").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r["position"] for r in order] == sorted(r["position"] for r in order)
    uses = defaultdict(int)
    for r in order:
        uses[r["doc_id"], r["text"]] += 1
    assert uses == {(r["doc_id"], r["text"]): r["n"] for r in mixed if r["n"]}


def test_empty_table(documents):
    assert mix(documents([])).count() == 0
    assert curriculum(documents([])).count() == 0


def test_due_time_inverts_the_integral(spark):
    for schedule in (*SCHEDULES, (0.0, 1.0, 3.0, 1.0)):
        parts = [i / 20 for i in range(21)]
        df = spark.createDataFrame([(p,) for p in parts], "p double")
        shape = F.array(*[F.lit(v) for v in schedule])
        steps = len(schedule) - 1
        area = sum((a + b) / 2 for a, b in zip(schedule, schedule[1:]))
        for p, t in df.select("p", due_time(F.col("p"), shape)).collect():
            done, x = 0.0, t * steps
            for i in range(steps):
                u = min(max(x - i, 0), 1)
                done += schedule[i] * u + (schedule[i + 1] - schedule[i]) * u * u / 2
            assert done / area == pytest.approx(p, abs=1e-9)


def test_curriculum_order_and_uses(documents):
    docs = documents([(i, "w " * 10, None, "abc"[i % 3]) for i in range(90)])
    rows = curriculum(docs).collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    assert all(0 <= r["position"] <= 1 for r in rows)
    assert len({(r["doc_id"], r["use"]) for r in rows}) == len(rows)
    assert abs(len(rows) * 10 - 1.5 * 900) <= 30
