"""Queries over broken files, checkable trees, grouped areas, gated scoring, stored profiles and streamed validation."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import key_bucket
from ..operators import auc_by_group as areas_by_group
from ..operators import validate
from ..operators.sketches import merge_profiles, profile_parts, rank_error, store_profiles, stored_profiles
from ..operators.trees import forest_probabilities, grow, walk
from ..schema import CONTRACT, KEY, LABEL
from ..session import scratch_path, written
from ..sources import credit, credit_dirty, from_rows
from ..sources.quarantine import quarantine, rows_of
from ..streaming import merged_report, read_stream, tally_stream
from .catalog import BUCKET_SQL, over_credit, over_dirty, query
from .features import build_pipeline, label_dictionary
from .gate import gate_and_score
from .model_queries import REPORT_CTE, REPORT_SELECT, forest_model, held_out_part, label_model
from .training import fit_timed, training_table
from .tree_table import ROOT, levels, saved_nodes

# --- broken files ------------------------------------------------------------------------------------------------

_LINE_COLUMNS = (
    KEY, "person_age", "person_income", "person_home_ownership", "loan_intent", "loan_amnt", "cb_person_default_on_file"
)
_SPOKEN = 'say "hi", then'
_OUTCOME_SQL = """CASE WHEN application_id % 50 = 1 THEN 'too_few_fields' WHEN application_id % 60 = 2 THEN 'too_many_fields'
  WHEN application_id % 70 = 3 THEN 'unclosed_quote' ELSE 'good' END"""


def broken_file(spark: SparkSession, sf_dir: str) -> str:
    """Applications as headed lines, some of them short, long or with an open quote, some quoted as they should be."""
    key = F.col(KEY)
    rows = credit(spark, sf_dir, _LINE_COLUMNS)
    intent = (
        F.when(key % 70 == 3, F.concat(F.lit('"'), "loan_intent"))
        .when(key % 80 == 4, F.lit('"say ""hi"", then"'))
        .otherwise(F.col("loan_intent"))
    )
    whole = {"person_income": F.col("person_income").cast("bigint"), "loan_amnt": F.col("loan_amnt").cast("bigint")}
    fields = [intent if c == "loan_intent" else whole.get(c, F.col(c)).cast("string") for c in _LINE_COLUMNS]
    line = (
        F.when(key % 50 == 1, F.concat_ws(",", *fields[:-2]))
        .when(key % 60 == 2, F.concat_ws(",", *[F.col(c).cast("string") for c in _LINE_COLUMNS], F.lit("extra"), F.lit("more")))
        .otherwise(F.concat_ws(",", *fields))
    )
    path = scratch_path(spark, "broken")
    # One column, named by the header: each file gets the header line, and every line goes out as it is.
    rows.select(line.alias(",".join(_LINE_COLUMNS))).write.options(header=True, sep="\u0001", quote="", escapeQuotes=False).csv(path)
    return path


@query(
    over_credit(
        f"""SELECT application_id, reason, CAST(CASE reason WHEN 'too_few_fields' THEN 5 WHEN 'too_many_fields' THEN 9 ELSE 7 END
  AS INT) AS n_fields FROM (SELECT application_id, {_OUTCOME_SQL} AS reason FROM credit) WHERE reason <> 'good'"""
    )
)
def csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The broken lines of a file, each with its reason; the key is read from the line as it came."""
    rejects = quarantine(spark, broken_file(spark, sf_dir)).rejects
    named = rejects.filter(F.col("file").isNotNull())
    return named.select(F.regexp_extract("line", "^[0-9]+", 0).cast("bigint").alias(KEY), "reason", "n_fields")


@query(
    over_credit(
        f"""SELECT outcome, COUNT(*) AS n_lines, CAST(SUM(CASE WHEN outcome = 'good' THEN person_income ELSE 0 END) AS BIGINT) AS income,
  CAST(COUNT(*) FILTER (outcome = 'good' AND application_id % 80 = 4) AS BIGINT) AS n_quoted
FROM (SELECT *, {_OUTCOME_SQL} AS outcome FROM credit) GROUP BY outcome"""
    )
)
def csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good lines, as rows, and rejected ones by reason: together all lines of the file."""
    found = quarantine(spark, broken_file(spark, sf_dir))
    lines = written(found.lines, "lines")
    good = rows_of(lines, list(_LINE_COLUMNS)).agg(
        F.lit("good").alias("outcome"),
        F.count("*").alias("n_lines"),
        F.coalesce(F.sum(F.col("person_income").try_cast("bigint")), F.lit(0)).alias("income"),
        F.count(F.when(F.col("loan_intent") == _SPOKEN, 1)).alias("n_quoted"),
    )
    rejected = lines.filter(F.col("reason").isNotNull()).groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("n_lines"))
    zero = F.lit(0).cast("bigint")
    return good.unionByName(rejected.withColumns({"income": zero, "n_quoted": zero}))


@query(
    over_credit(f"SELECT {', '.join(CONTRACT)} FROM credit ORDER BY application_id LIMIT 10"),
)
def local_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A handful of applications that the caller holds, under the declared types."""
    held = [tuple(r) for r in credit(spark, sf_dir).orderBy(KEY).limit(10).select(*CONTRACT).collect()]
    return from_rows(spark, held, CONTRACT)


# --- trees -------------------------------------------------------------------------------------------------------

_STUMP_FEATURES = ("person_age", "cb_person_cred_hist_length", "rents", "rate_step", "share_step")
_STEPS = {
    "rents": "CAST(person_home_ownership = 'RENT' AS INT)",
    "rate_step": "CAST(FLOOR(COALESCE(loan_int_rate, 0)) AS INT)",
    "share_step": "CAST(LEAST(FLOOR(loan_percent_income * 10), 40) AS INT)",
}
_STUMP_COLUMNS = ("person_age", "cb_person_cred_hist_length", "person_home_ownership", "loan_int_rate", "loan_percent_income")
_MANY_BINS = 128  # more than any of the features has values


def stepped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few-valued inputs, on which a tree's numbers are exact."""
    rows = credit(spark, sf_dir, [KEY, *_STUMP_COLUMNS, LABEL])
    return rows.select(KEY, "person_age", "cb_person_cred_hist_length", *[F.expr(e).alias(n) for n, e in _STEPS.items()], LABEL)


def library_tree(rows: DataFrame, depth: int):
    """The library's tree on the same inputs."""
    vectors = VectorAssembler(inputCols=list(_STUMP_FEATURES), outputCol="features").transform(rows)
    tree = DecisionTreeClassifier(featuresCol="features", labelCol=LABEL, maxDepth=depth, maxBins=_MANY_BINS)
    return tree.fit(vectors), vectors


def _sides(nodes: DataFrame) -> DataFrame:
    """The split at the root and the rows and defaults on either side."""
    root = nodes.filter("depth = 0" if "depth" in nodes.columns else f"node = {ROOT}").select("feature", "threshold", "left", "right")
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("counts").alias(f"{name}_counts"))
    joined = root.join(side("left"), "left").join(side("right"), "right")
    share = lambda c: F.round(F.get(c, F.lit(1)) / (F.get(c, F.lit(0)) + F.get(c, F.lit(1))), 9)
    size = lambda c: (F.get(c, F.lit(0)) + F.get(c, F.lit(1))).cast("bigint")
    return joined.select(
        F.element_at(F.array(*[F.lit(f) for f in _STUMP_FEATURES]), F.col("feature") + 1).alias("feature"), "threshold",
        size("left_counts").alias("n_left"), size("right_counts").alias("n_right"),
        share("left_counts").alias("p_left"), share("right_counts").alias("p_right"),
    )


_VALUES_SQL = " UNION ALL ".join(
    f"SELECT {i} AS f, '{n}' AS feature, CAST({_STEPS.get(n, n)} AS DOUBLE) AS v, loan_status AS y FROM credit"
    for i, n in enumerate(_STUMP_FEATURES)
)


@query(
    over_credit(
        f""",
x AS ({_VALUES_SQL}),
t AS (SELECT f, feature, v, SUM(y) AS d, COUNT(*) AS n FROM x GROUP BY f, feature, v),
c AS (SELECT f, feature, v, LEAD(v) OVER w AS up, SUM(d) OVER w AS dl, SUM(n) OVER w AS nl,
        SUM(d) OVER (PARTITION BY f) AS da, SUM(n) OVER (PARTITION BY f) AS na
      FROM t WINDOW w AS (PARTITION BY f ORDER BY v)),
g AS (SELECT *, CAST(dl AS DOUBLE) / nl AS pl, CAST(da - dl AS DOUBLE) / (na - nl) AS pr, CAST(da AS DOUBLE) / na AS pa
      FROM c WHERE up IS NOT NULL),
b AS (SELECT *, 2 * pa * (1 - pa) - CAST(nl AS DOUBLE) / na * 2 * pl * (1 - pl)
        - CAST(na - nl AS DOUBLE) / na * 2 * pr * (1 - pr) AS gain FROM g ORDER BY gain DESC, f, v LIMIT 1)
SELECT feature, (v + up) / 2 AS threshold, CAST(nl AS BIGINT) AS n_left, CAST(na - nl AS BIGINT) AS n_right,
  ROUND(pl, 9) AS p_left, ROUND(pr, 9) AS p_right, TRUE AS library_agrees FROM b"""
    )
)
def stump_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best split of the loan table and the default rate on either side, and that the library splits alike."""
    rows = written(stepped(spark, sf_dir), "stepped")
    own = _sides(grow(rows, _STUMP_FEATURES, LABEL, depth=1, bins=_MANY_BINS, prune=False))
    theirs = _sides(saved_nodes(library_tree(rows, 1)[0]))
    agrees = theirs.select(F.struct(*theirs.columns).alias("theirs"))
    return own.join(agrees, how="left").select(*own.columns, F.coalesce(F.col("theirs") == F.struct(*own.columns), F.lit(False)).alias("library_agrees"))


@query(
    over_credit(
        "SELECT COUNT(*) AS n_rows, CAST(SUM(loan_status) AS BIGINT) AS n_default, COUNT(*) AS n_walked, "
        "CAST(SUM(loan_status) AS BIGINT) AS n_default_walked, CAST(0 AS BIGINT) AS n_leaf_differs, TRUE AS is_binary FROM credit"
    )
)
def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library tree's leaves hold the rows that walk to them: counts in the node table against a walk of all rows."""
    rows = written(stepped(spark, sf_dir), "stepped")
    model, _ = library_tree(rows, 4)
    nodes = written(saved_nodes(model), "nodes")
    leaf = nodes.filter("left IS NULL").select("node", F.get("counts", F.lit(0)).alias("c0"), F.get("counts", F.lit(1)).alias("c1"))
    values = F.array(*[F.col(c).cast("double") for c in _STUMP_FEATURES])
    ends = walk(rows.select(LABEL, values.alias("x")), nodes, "x", depth=4, root=ROOT)
    # Leaves are told apart by their counts; equal ones are compared as a group.
    walked = ends.groupBy(F.get("counts", F.lit(0)).alias("c0"), F.get("counts", F.lit(1)).alias("c1")).agg(
        F.count("*").alias("n"), F.sum(LABEL).alias("d")
    )
    held = leaf.groupBy("c0", "c1").agg(F.sum(F.col("c0") + F.col("c1")).alias("hn"), F.sum("c1").alias("hd"))
    both = held.join(walked, ["c0", "c1"], "full_outer")
    shape = nodes.agg((F.count("*") == 2 * F.count("left") + 1).alias("is_binary"))
    same = (F.col("hn") == F.col("n")) & (F.col("hd") == F.col("d"))
    return both.agg(
        F.sum("hn").cast("bigint").alias("n_rows"), F.sum("hd").cast("bigint").alias("n_default"),
        F.sum("n").alias("n_walked"), F.sum("d").alias("n_default_walked"),
        F.count(F.when(~F.coalesce(same, F.lit(False)), 1)).alias("n_leaf_differs"),
    ).join(shape, how="left")


@query(over_credit(f"SELECT application_id, loan_status, TRUE AS walks_alike FROM credit WHERE {BUCKET_SQL} >= 800"))
def tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every held-out row walked through the forest's node table by joins: the probabilities that the model gives."""
    model = forest_model(spark, sf_dir)
    predicted = model.transform(held_out_part(spark, sf_dir))
    p = vector_to_array("probability")
    rows = written(predicted.select(KEY, LABEL, vector_to_array("features_scaler").alias("x"), p.alias("p_model")), "walked")
    nodes = written(saved_nodes(model.stages[-1]), "nodes")
    found = forest_probabilities(rows, nodes, KEY, "x", classes=2, depth=model.stages[-1].getMaxDepth(), root=ROOT)
    apart = F.greatest(*[F.abs(F.get("p", F.lit(i)) - F.get("p_model", F.lit(i))) for i in range(2)])
    return rows.join(found, KEY, "left").select(KEY, LABEL, F.coalesce(apart <= 1e-12, F.lit(False)).alias("walks_alike"))


@query("SELECT CAST(t.range AS INT) AS tree, CAST(1 AS BIGINT) AS n_roots, TRUE AS levels_follow FROM range(20) t")
def tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per tree of the fitted forest: each level has two nodes per split of the level above, and the rows of these splits."""
    nodes = written(saved_nodes(forest_model(spark, sf_dir).stages[-1]), "nodes")
    by_level = levels(nodes).join(nodes, ["tree", "node"]).groupBy("tree", "level").agg(
        F.count("*").alias("n_nodes"),
        F.count("left").alias("n_splits"),
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("left").isNotNull(), F.col("n"))), F.lit(0)).alias("split_rows"),
    )
    below = Window.partitionBy("tree").orderBy("level")  # a row per level
    follows = (2 * F.col("n_splits") == F.coalesce(F.lead("n_nodes").over(below), F.lit(0))) & (
        F.col("split_rows") == F.coalesce(F.lead("n_rows").over(below), F.lit(0))
    )
    checked = by_level.withColumn("follows", follows)
    root = F.sum(F.when(F.col("level") == 0, F.col("n_nodes")))
    return checked.groupBy("tree").agg(root.alias("n_roots"), F.every("follows").alias("levels_follow"))


_STAGE_KINDS = ("ImputerModel", "StringIndexerModel", "OneHotEncoderModel", "VectorAssembler", "StandardScalerModel", "RandomForestClassificationModel")


@query(
    over_credit(
        "SELECT * FROM (VALUES "
        + ", ".join(f"({i}, '{k}', TRUE)" for i, k in enumerate(_STAGE_KINDS))
        + ") AS t(stage, kind, is_timed)"
    )
)
def fit_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall-clock of each stage of a fit on the whole table."""
    _, times = fit_timed(build_pipeline(), training_table(credit(spark, sf_dir)))
    return times.select("stage", "kind", (F.col("seconds") >= 0).alias("is_timed"))


# --- areas by group ----------------------------------------------------------------------------------------------


@query(
    over_credit(
        """,
t AS (SELECT loan_intent, person_home_ownership, loan_int_rate AS s, SUM(loan_status) AS p, SUM(1 - loan_status) AS q
      FROM credit WHERE loan_int_rate IS NOT NULL GROUP BY ALL),
c AS (SELECT *, COALESCE(SUM(q) OVER (PARTITION BY loan_intent, person_home_ownership ORDER BY s
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t)
SELECT loan_intent, person_home_ownership, CAST(SUM(p) AS BIGINT) AS n_pos, CAST(SUM(q) AS BIGINT) AS n_neg,
  ROUND(CAST(SUM(p * (2 * b + q)) AS DOUBLE) / NULLIF(2 * CAST(SUM(p) AS DOUBLE) * CAST(SUM(q) AS DOUBLE), 0), 12) AS area
FROM c GROUP BY ALL"""
    )
)
def auc_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the interest rate ranks defaults, by intent and ownership."""
    by = ["loan_intent", "person_home_ownership"]
    rows = credit(spark, sf_dir, [*by, "loan_int_rate", LABEL])
    return areas_by_group(rows, by, "loan_int_rate").withColumn("area", F.round("area", 12))


# --- gated scoring -----------------------------------------------------------------------------------------------

_HOLES = "application_id % 90 = 5"
_REPORT_COLUMNS = ("level", "kind", "column_name", "value", "allowed", "n")


@query(
    over_dirty(
        f"""{REPORT_CTE}, dirty_report AS ({REPORT_SELECT})
SELECT 'dirty' AS input, * FROM dirty_report
UNION ALL SELECT 'holes', 'warning', 'valeur_manquante', 'person_age', NULL, NULL, COUNT(*) FROM credit WHERE {_HOLES} HAVING COUNT(*) > 0
UNION ALL SELECT 'holes', 'verdict', 'compatible', NULL, NULL, NULL, COUNT(*) FROM credit
UNION ALL SELECT 'holes', 'outcome', 'scored', NULL, NULL, NULL, COUNT(*) FROM credit WHERE NOT ({_HOLES})
UNION ALL SELECT 'holes', 'outcome', 'rejected', NULL, NULL, NULL, COUNT(*) FROM credit WHERE {_HOLES}"""
    )
)
def gated_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables through the gate: one that is refused, and one whose rows are scored or set aside."""
    model = forest_model(spark, sf_dir)
    holes = credit(spark, sf_dir).withColumn("person_age", F.when(~F.expr(_HOLES), F.col("person_age")))
    refused, passed = gate_and_score(model, credit_dirty(spark, sf_dir)), gate_and_score(model, holes)
    out = refused.report.withColumn("input", F.lit("dirty")).unionByName(passed.report.withColumn("input", F.lit("holes")))
    for name, gated in (("dirty", refused), ("holes", passed)):
        for kind, rows in (("scored", gated.scored), ("rejected", gated.rejects)):
            if rows is not None:
                none = F.lit(None).cast("string")
                counted = rows.agg(F.count("*").alias("n")).select(
                    F.lit("outcome").alias("level"), F.lit(kind).alias("kind"), none.alias("column_name"), none.alias("value"),
                    none.alias("allowed"), "n", F.lit(name).alias("input"),
                )
                out = out.unionByName(counted)
    return out.select("input", *_REPORT_COLUMNS)


@query(
    over_credit(
        "SELECT 'error' AS level, 'colonnes_manquantes' AS kind, m.c AS column_name, CAST(NULL AS VARCHAR) AS value, "
        f"'{', '.join(CONTRACT)}' AS allowed, CAST(1 AS BIGINT) AS n FROM (VALUES ('loan_amnt'), ('loan_intent')) m(c) "
        "UNION ALL SELECT 'verdict', 'incompatible', NULL, NULL, NULL, COUNT(*) FROM credit"
    )
)
def missing_columns_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lacking = credit(spark, sf_dir).drop("loan_amnt", "loan_intent")
    return validate(lacking, label_dictionary(label_model(spark, sf_dir)), KEY)


@query(over_dirty(f"{REPORT_CTE}\n{REPORT_SELECT}"))
def stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over two deliveries of files, tallied by a stream that was stopped in between."""
    labels = label_dictionary(label_model(spark, sf_dir))
    landing, out, checkpoint = (scratch_path(spark, f"report-{p}") for p in ("landing", "out", "checkpoint"))
    rows = credit_dirty(spark, sf_dir)
    early = key_bucket(F.col(KEY)) < 500
    for delivery in (rows.filter(early), rows.filter(~early)):
        delivery.write.mode("append").parquet(landing)
        stream = read_stream(spark, landing, rows.schema)
        tally_stream(stream, labels, out, checkpoint).awaitTermination()
    return merged_report(spark, out, labels, rows.columns)


# --- stored profiles ---------------------------------------------------------------------------------------------

_PROFILED = ("person_income", "loan_amnt", "loan_int_rate", "person_emp_length")
_PROBS = (0.25, 0.5, 0.75)


@query(
    over_credit(
        " UNION ALL ".join(
            f"SELECT {parts} AS parts, '{c}' AS column_name, COUNT({c}) AS n, COUNT(*) - COUNT({c}) AS n_missing, "
            f"ROUND(AVG({c}), 6) AS mean, ROUND(STDDEV_SAMP({c}), 4) AS sd, MIN({c}) AS low, MAX({c}) AS high, "
            "TRUE AS ranks_within FROM credit"
            for parts in (1, 50)
            for c in _PROFILED
        )
    )
)
def profile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles stored per part and merged without the rows, for 1 and 50 parts; their quantiles' ranks among the rows."""
    rows = credit(spark, sf_dir, [KEY, *_PROFILED])
    path, found = scratch_path(spark, "profiles"), []
    for parts in (1, 50):
        part = F.concat_ws("-", F.lit(str(parts)), (key_bucket(F.col(KEY)) % parts).cast("string"))
        store_profiles(profile_parts(rows.withColumn("part", part), _PROFILED, "part"), path)
        stored = stored_profiles(spark, path).filter(F.col("part").startswith(f"{parts}-"))
        found.append(merge_profiles(stored, _PROBS).withColumn("parts", F.lit(parts)))
    merged = written(found[0].unionByName(found[1]), "merged-profiles")

    # How many rows lie below and up to each quantile: one more pass, only to check the ranks.
    asked = [(r["parts"], r["column_name"], r["n"], p, q) for r in merged.collect() for p, q in zip(_PROBS, r["quantiles"])]
    counts = [f(F.when(test, 1)) for _, c, _, _, q in asked for f, test in ((F.count, F.col(c) < q), (F.count, F.col(c) <= q))]
    seen = rows.agg(*[c.alias(f"k{i}") for i, c in enumerate(counts)]).first()
    off = rank_error()
    within: dict[tuple[int, str], bool] = {}
    for i, (parts, c, n, p, _) in enumerate(asked):
        ok = seen[2 * i] <= (p + off) * n and seen[2 * i + 1] >= (p - off) * n
        within[parts, c] = within.get((parts, c), True) and ok
    checked = spark.createDataFrame([(*at, ok) for at, ok in within.items()], "parts int, column_name string, ranks_within boolean")
    return merged.join(checked, ["parts", "column_name"]).select(
        "parts", "column_name", "n", "n_missing", F.round("mean", 6).alias("mean"), F.round("sd", 4).alias("sd"), "low", "high",
        "ranks_within",
    )
