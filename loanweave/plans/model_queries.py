"""Queries over features, models, validation and scoring."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ALERT_POLICY, REVIEW_POLICY, separate_vector
from ..operators import auc, auc_by_group, confusion, is_train, label_frame, split
from ..operators import nonnumeric_counts as count_nonnumeric
from ..operators import regression_metrics as metrics_of
from ..operators import stratified_split as split_strata
from ..operators import unknown_categories as find_unknown
from ..operators import validate
from ..schema import CATEGORICAL, CONTRACT, IMPUTED, KEY, LABEL, NUMERIC
from ..session import scratch_path, written
from ..sources import credit, credit_dirty, export_csv, table
from ..streaming import read_stream, score_stream
from .catalog import BUCKET_SQL, over_credit, over_dirty, query
from .features import (
    ENCODED_NAMES,
    IMPUTED_NAMES,
    INDEXED_NAMES,
    exact_medians,
    feature_stages,
    fit_labels,
    label_dictionary,
    label_encoder,
    label_indexer,
    label_table,
    median_filler,
)
from .scoring import score, score_applicants, score_summary
from .training import coefficients, fit_linear, fit_tree, load, persisted, predict_tree, save, train
from .tuning import tune

def label_model(spark: SparkSession, sf_dir: str) -> PipelineModel:
    """The label indexer fitted on the whole table; line items are not read."""
    return fit_labels(credit(spark, sf_dir, CATEGORICAL))


def forest_model(spark: SparkSession, sf_dir: str) -> PipelineModel:
    """The untuned pipeline fitted on the training part."""
    return train(credit(spark, sf_dir).filter(is_train()))


def held_out_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(credit(spark, sf_dir))[1]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feature stages, with exact medians; the table is derived once for the fit and for the rows."""
    rows = written(credit(spark, sf_dir, [KEY, *CONTRACT]), "contract")
    return Pipeline(stages=feature_stages(medians=exact_medians(rows))).fit(rows).transform(rows)


def labelled(spark: SparkSession, sf_dir: str, stages: list) -> DataFrame:
    """The stages that only need the categories."""
    rows = written(credit(spark, sf_dir, [KEY, *CATEGORICAL]), "categories")
    return Pipeline(stages=stages).fit(rows).transform(rows)


# --- feature stages ----------------------------------------------------------------------------------------------

_IMPUTED_SQL = ", ".join(
    f"COALESCE({c}, (SELECT QUANTILE_DISC({c}, 0.5) FROM credit)) AS {IMPUTED_NAMES[c]}" for c in IMPUTED
)
_INDEX_CTES = ",\n".join(
    f"ix_{c} AS (SELECT {c} AS v, CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {c}) - 1 AS INT) AS i "
    f"FROM credit GROUP BY {c})"
    for c in CATEGORICAL
)
_INDEX_JOINS = " ".join(f"JOIN ix_{c} ON ix_{c}.v = credit.{c}" for c in CATEGORICAL)
# Categories of the table less the last, which one-hot encoding drops.
_HOT_SIZE = {"person_home_ownership": 3, "loan_intent": 5, "cb_person_default_on_file": 1}


def _hot_sql(column: str) -> list[str]:
    return [f"CAST(ix_{column}.i = {p} AS DOUBLE)" for p in range(_HOT_SIZE[column])]


_VECTOR_SQL = [
    "CAST(person_age AS DOUBLE)",
    "person_income",
    *[f"COALESCE({c}, (SELECT QUANTILE_DISC({c}, 0.5) FROM credit))" for c in IMPUTED],
    *[term for c in CATEGORICAL for term in _hot_sql(c)],
    "loan_amnt",
    "CAST(cb_person_cred_hist_length AS DOUBLE)",
]
_POSITIONS = range(len(_VECTOR_SQL))
_ASSEMBLED = f""",
{_INDEX_CTES},
vec AS (SELECT application_id, {", ".join(f"{e} AS f{i}" for i, e in enumerate(_VECTOR_SQL))}
        FROM credit {_INDEX_JOINS})"""


@query(over_credit(f"SELECT application_id, {_IMPUTED_SQL} FROM credit"))
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(credit(spark, sf_dir, [KEY, *IMPUTED]), "to-impute")
    return median_filler(exact_medians(rows)).transform(rows).select(KEY, *IMPUTED_NAMES.values())


@query(
    over_credit(
        f",\n{_INDEX_CTES}\nSELECT application_id, {', '.join(f'ix_{c}.i AS {INDEXED_NAMES[c]}' for c in CATEGORICAL)} "
        f"FROM credit {_INDEX_JOINS}"
    )
)
def index_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = labelled(spark, sf_dir, [label_indexer()])
    return indexed.select(KEY, *[F.col(c).cast("int").alias(c) for c in INDEXED_NAMES.values()])


def _hot_names(column: str) -> list[str]:
    return [f"{ENCODED_NAMES[column]}_{p}" for p in range(_HOT_SIZE[column])]


@query(
    over_credit(
        f",\n{_INDEX_CTES}\nSELECT application_id, "
        + ", ".join(f"{e} AS {n}" for c in CATEGORICAL for e, n in zip(_hot_sql(c), _hot_names(c)))
        + f" FROM credit {_INDEX_JOINS}"
    )
)
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled(spark, sf_dir, [label_indexer(), label_encoder()])
    for c in CATEGORICAL:
        df = separate_vector(df, ENCODED_NAMES[c], _hot_names(c))
    return df.select(KEY, *[n for c in CATEGORICAL for n in _hot_names(c)])


@query(over_credit(f"{_ASSEMBLED}\nSELECT * FROM vec"))
def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"f{i}" for i in _POSITIONS]
    return separate_vector(features(spark, sf_dir), "features", names).select(KEY, *names)


@query(
    over_credit(
        f"{_ASSEMBLED},\nsd AS (SELECT {', '.join(f'STDDEV_SAMP(f{i}) AS d{i}' for i in _POSITIONS)} FROM vec)\n"
        f"SELECT application_id, {', '.join(f'ROUND(COALESCE(f{i} / NULLIF(d{i}, 0), 0), 6) AS s{i}' for i in _POSITIONS)} "
        "FROM vec, sd"
    )
)
def scale_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"s{i}" for i in _POSITIONS]
    return separate_vector(features(spark, sf_dir), "features_scaler", names).select(
        KEY, *[F.round(n, 6).alias(n) for n in names]
    )


@query(
    over_credit(
        f",\n{_INDEX_CTES}\n"
        + " UNION ALL ".join(f"SELECT '{c}' AS column_name, i AS idx, v AS label FROM ix_{c}" for c in CATEGORICAL)
    ),
    name="label_dictionary",
)
def label_dictionary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_table(label_model(spark, sf_dir), spark)


# --- regression --------------------------------------------------------------------------------------------------

SIMPLE = "loan_amnt ~ person_income"
MULTIPLE = "loan_amnt ~ person_income + person_age + loan_percent_income"
_REGRESSION_COLUMNS = ["loan_amnt", "person_income", "person_age", "loan_percent_income"]


def _linear(spark: SparkSession, sf_dir: str, formula: str) -> PipelineModel:
    with persisted(credit(spark, sf_dir, _REGRESSION_COLUMNS)) as rows:
        return fit_linear(rows, formula)


def _coefficients(spark: SparkSession, sf_dir: str, formula: str) -> DataFrame:
    rows = credit(spark, sf_dir, _REGRESSION_COLUMNS)
    return coefficients(_linear(spark, sf_dir, formula), rows).withColumn("coefficient", F.round("coefficient", 6))


@query(
    over_credit(
        """SELECT '(intercept)' AS term, ROUND(REGR_INTERCEPT(loan_amnt, person_income), 6) AS coefficient FROM credit
UNION ALL SELECT 'person_income', ROUND(REGR_SLOPE(loan_amnt, person_income), 6) FROM credit"""
    )
)
def linreg_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(spark, sf_dir, SIMPLE)


# Least squares on three predictors by solving the centred normal equations with Cramer's rule.
@query(
    over_credit(
        """,
m AS (SELECT COVAR_POP(a, a) aa, COVAR_POP(a, b) ab, COVAR_POP(a, c) ac, COVAR_POP(b, b) bb, COVAR_POP(b, c) bc,
        COVAR_POP(c, c) cc, COVAR_POP(a, y) ay, COVAR_POP(b, y) byy, COVAR_POP(c, y) cy,
        AVG(a) ma, AVG(b) mb, AVG(c) mc, AVG(y) my
      FROM (SELECT person_income AS a, CAST(person_age AS DOUBLE) AS b, loan_percent_income AS c, loan_amnt AS y
            FROM credit)),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m),
k AS (SELECT *,
  (ay * (bb * cc - bc * bc) - ab * (byy * cc - bc * cy) + ac * (byy * bc - bb * cy)) / det AS ka,
  (aa * (byy * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - byy * ac)) / det AS kb,
  (aa * (bb * cy - byy * bc) - ab * (ab * cy - byy * ac) + ay * (ab * bc - bb * ac)) / det AS kc FROM d)
SELECT '(intercept)' AS term, ROUND(my - ka * ma - kb * mb - kc * mc, 3) AS coefficient FROM k
UNION ALL SELECT 'person_income', ROUND(ka, 3) FROM k
UNION ALL SELECT 'person_age', ROUND(kb, 3) FROM k
UNION ALL SELECT 'loan_percent_income', ROUND(kc, 3) FROM k"""
    )
)
def linreg_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(spark, sf_dir, MULTIPLE).withColumn("coefficient", F.round("coefficient", 3))


@query(
    over_credit(
        """,
k AS (SELECT REGR_SLOPE(loan_amnt, person_income) AS s, REGR_INTERCEPT(loan_amnt, person_income) AS i,
        AVG(loan_amnt) AS my FROM credit),
p AS (SELECT loan_amnt AS y, i + s * person_income AS yhat, my FROM credit, k)
SELECT ROUND(AVG((yhat - my) * (yhat - my)), 2) AS explained_variance, ROUND(AVG(ABS(y - yhat)), 4) AS mae,
  ROUND(AVG((y - yhat) * (y - yhat)), 2) AS mse, ROUND(SQRT(AVG((y - yhat) * (y - yhat))), 4) AS rmse,
  ROUND(1 - SUM((y - yhat) * (y - yhat)) / SUM((y - my) * (y - my)), 6) AS r2 FROM p"""
    )
)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = credit(spark, sf_dir, ["loan_amnt", "person_income"])
    metrics = metrics_of(_linear(spark, sf_dir, SIMPLE).transform(rows), "loan_amnt", "prediction")
    digits = {"explained_variance": 2, "mae": 4, "mse": 2, "rmse": 4, "r2": 6}
    return metrics.select(*[F.round(c, d).alias(c) for c, d in digits.items()])


# --- multi-class tree --------------------------------------------------------------------------------------------


_HELD_VECTORS_SQL = """WITH h AS (SELECT vec_id, label, ROW_NUMBER() OVER (PARTITION BY label ORDER BY
          SUBSTR(MD5(CONCAT(CAST(vec_id AS VARCHAR), '-123')), 1, 13), vec_id) AS rn,
        COUNT(*) OVER (PARTITION BY label) AS size FROM embeddings),
held AS (SELECT vec_id, label FROM h WHERE rn > CEIL(0.75 * size))
"""


def tree_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows (a quarter of each class) with the tree's class and the probability of each class."""
    fit_part, held_out = split_strata(table(spark, sf_dir, "embeddings"), "label", key="vec_id")
    model = fit_tree(fit_part, "embedding", "label")
    return predict_tree(model, held_out, "embedding").select(
        "vec_id", "label", F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability").alias("p")
    )


# Each held-out row gets a class, and it is the first most probable one; the probabilities sum to 1.
@query(f"{_HELD_VECTORS_SQL}SELECT vec_id, label, TRUE AS class_follows, TRUE AS sums_to_one FROM held")
def tree_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    most_probable = F.array_position("p", F.array_max("p")) - 1
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return tree_predictions(spark, sf_dir).select(
        "vec_id", "label", (F.col("predicted") == most_probable).alias("class_follows"), (F.abs(total - 1) < 1e-9).alias("sums_to_one")
    )


# The cells of each row of the matrix together hold the rows of the class.
@query(
    f"{_HELD_VECTORS_SQL}SELECT CAST(c.range AS INT) AS truth, COUNT(held.vec_id) AS n_rows, CAST(0 AS BIGINT) AS n_no_class "
    "FROM range(10) c LEFT JOIN held ON held.label = c.range GROUP BY 1"
)
def confusion_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = confusion(tree_predictions(spark, sf_dir), "label", "predicted", range(10))
    cells = reduce(add, [F.col(f"pred_{c}") for c in range(10)])
    return matrix.select("truth", cells.alias("n_rows"), F.col("pred_other").alias("n_no_class"))


# --- forest ------------------------------------------------------------------------------------------------------
# SQL cannot grow the trees; the oracles list the rows that must come, and what must hold for each.


def _held_sql(*checks: str) -> str:
    listed = "".join(f", TRUE AS {c}" for c in checks)
    return over_credit(f"SELECT application_id, loan_status{listed} FROM credit WHERE {BUCKET_SQL} >= 800")


_ALERT_BAND = "CASE WHEN p < 0.3 THEN 'low' WHEN p < 0.6 THEN 'moderate' ELSE 'high' END"
_REVIEW_BAND = "CASE WHEN p < 0.3 THEN 'accept' WHEN p < 0.5 THEN 'review' ELSE 'refuse' END"


@query(_held_sql("is_probability", "class_follows", "band_follows", "decision_follows"))
def rf_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = score(forest_model(spark, sf_dir), held_out_part(spark, sf_dir))
    return scored.withColumn("p", F.col("probability_default")).select(
        KEY,
        LABEL,
        F.expr("p BETWEEN 0 AND 1").alias("is_probability"),
        F.expr("prediction = CAST(p > 0.5 AS INT)").alias("class_follows"),
        F.expr(f"risk_level = {_ALERT_BAND}").alias("band_follows"),
        F.expr("decision = IF(p > 0.5, 'default', 'no default')").alias("decision_follows"),
    )


@query(_held_sql("sums_to_one", "class_follows"))
def score_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = forest_model(spark, sf_dir).transform(held_out_part(spark, sf_dir))
    return separate_vector(predicted, "probability", ["proba0", "proba1"]).select(
        KEY,
        LABEL,
        F.expr("ABS(proba0 + proba1 - 1) < 1e-9").alias("sums_to_one"),
        F.expr("prediction = CAST(proba1 > proba0 AS INT)").alias("class_follows"),
    )


# Single applications are answered alike under either policy: the same class, a probability of 4 digits, its own band.
@query(_held_sql("is_rounded", "alert_follows", "review_follows"))
def score_applicant(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = forest_model(spark, sf_dir), held_out_part(spark, sf_dir)
    exact = score(model, rows)[0].select(KEY, LABEL, F.col("probability_default").alias("p"))
    alert = score_applicants(model, rows, ALERT_POLICY).select(KEY, F.col("probability_default").alias("q"), F.col("risk_level").alias("alert"))
    review = score_applicants(model, rows, REVIEW_POLICY).select(KEY, F.col("risk_level").alias("review"))
    return exact.join(alert, KEY).join(review, KEY).select(
        KEY,
        LABEL,
        F.expr("q = ROUND(p, 4)").alias("is_rounded"),
        F.expr(f"alert = {_ALERT_BAND}").alias("alert_follows"),
        F.expr(f"review = {_REVIEW_BAND}").alias("review_follows"),
    )


@query(
    over_credit(
        "SELECT CAST(SUM(loan_status) AS BIGINT) AS n_default, CAST(SUM(1 - loan_status) AS BIGINT) AS n_other, "
        f"CAST(0 AS DOUBLE) AS difference, TRUE AS beats_chance FROM credit WHERE {BUCKET_SQL} >= 800"
    )
)
def auc_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = score(forest_model(spark, sf_dir), held_out_part(spark, sf_dir))
    with persisted(scored.select(F.col("probability_default").alias("p"), LABEL)) as rows:
        evaluated = auc(rows, "p")
    return auc_by_group(scored, [], "probability_default").select(
        F.col("n_pos").alias("n_default"),
        F.col("n_neg").alias("n_other"),
        F.abs(F.round(F.col("area") - evaluated, 9)).alias("difference"),
        (F.col("area") > 0.5).alias("beats_chance"),
    )


@query(
    over_credit(
        "SELECT COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS n_default_differs, CAST(0 AS DOUBLE) AS rate_differs "
        f"FROM credit WHERE {BUCKET_SQL} >= 800"
    )
)
def batch_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary less a tally of the decisions it sums up."""
    scored, _ = score(forest_model(spark, sf_dir), held_out_part(spark, sf_dir))
    tally = scored.agg(F.count(F.when(F.col("decision") == "default", 1)).alias("n")).scalar()
    return score_summary(scored).select(
        "n_rows",
        (F.col("n_default") - tally).alias("n_default_differs"),
        F.abs(F.round(F.col("default_rate") - tally / F.col("n_rows"), 9)).alias("rate_differs"),
    )


# Every grid point of the search, with an area over all folds.
@query(
    over_credit(
        "SELECT t.n AS num_trees, d.n AS max_depth, i.k AS impurity, TRUE AS is_area FROM (VALUES (20), (50), (100)) t(n), "
        "(VALUES (3), (5), (10)) d(n), (VALUES ('entropy'), ('gini')) i(k)"
    )
)
def cv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, metrics = tune(credit(spark, sf_dir).filter(is_train()))
    return metrics.select(
        "num_trees", "max_depth", "impurity", F.col("area_under_roc").between(0.5, 1).alias("is_area")
    )


@query()
def cv_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: the area under ROC of each of the 18 grid points over 5 folds, best first, and that of the best
    one, refitted on all training rows, on the rows held out from the search."""
    best, metrics = tune(credit(spark, sf_dir).filter(is_train()))
    scored, _ = score(best, held_out_part(spark, sf_dir))
    area = auc_by_group(scored, [], "probability_default").select("area").scalar()
    forest = best.stages[-1]
    is_best = (
        (F.col("num_trees") == forest.getNumTrees)
        & (F.col("max_depth") == forest.getMaxDepth())
        & (F.col("impurity") == forest.getImpurity())
    )
    return metrics.withColumn("hold_out_area", F.when(is_best, area))


# How many test rows there are, and that none differs.
_SAME_SQL = over_credit(
    f"SELECT COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM credit WHERE {BUCKET_SQL} >= 800"
)


def _differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of both tables together, matched by key, and how many lack a partner or score differently."""
    pick = lambda df, suffix: df.select(
        KEY, F.col("prediction").alias(f"c{suffix}"), F.col("probability_default").alias(f"p{suffix}")
    )
    same = F.col("c1").eqNullSafe(F.col("c2")) & (F.abs(F.col("p1") - F.col("p2")) <= 1e-12)
    return (
        pick(one, 1)
        .join(pick(other, 2), KEY, "full_outer")
        .agg(F.count("*").alias("n_rows"), F.count(F.when(~F.coalesce(same, F.lit(False)), 1)).alias("n_different"))
    )


@query(_SAME_SQL)
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, path = forest_model(spark, sf_dir), scratch_path(spark, "model")
    save(model, path)
    rows = held_out_part(spark, sf_dir)
    return _differences(score(model, rows)[0], score(load(path), rows)[0])


@query(_SAME_SQL)
def tuned_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best model of the whole search, saved and loaded, on the rows held out from the search."""
    model, _ = tune(credit(spark, sf_dir).filter(is_train()))
    path, rows = scratch_path(spark, "tuned"), held_out_part(spark, sf_dir)
    save(model, path)
    return _differences(score(model, rows)[0], score(load(path), rows)[0])


@query(_SAME_SQL)
def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = score(forest_model(spark, sf_dir), held_out_part(spark, sf_dir))
    path = export_csv(scored, scratch_path(spark, "scores"))
    return _differences(scored, spark.read.schema(scored.schema).option("header", True).csv(path))


@query(_SAME_SQL)
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = forest_model(spark, sf_dir), held_out_part(spark, sf_dir)
    landing, out, checkpoint = (scratch_path(spark, f"stream-{p}") for p in ("landing", "out", "checkpoint"))
    rows.write.parquet(landing)
    score_stream(model, read_stream(spark, landing), out, checkpoint).awaitTermination()
    batch = score(model, rows)[0]
    return _differences(batch, spark.read.schema(batch.schema).parquet(f"{out}/scored"))


# --- validation and rejects --------------------------------------------------------------------------------------


@query(
    over_dirty(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, COUNT(*) FILTER ({c} IS NOT NULL AND TRY_CAST(TRIM({c}) AS DOUBLE) IS NULL) "
            "AS n_bad FROM credit_dirty"
            for c in NUMERIC
        )
    )
)
def nonnumeric_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_nonnumeric(credit_dirty(spark, sf_dir))


def _unknown_sql(columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS value, COUNT(*) AS n FROM credit_dirty WHERE {c} IS NOT NULL "
        f"AND {c} NOT IN (SELECT {c} FROM credit) GROUP BY {c}"
        for c in columns
    )


@query(over_dirty(_unknown_sql(CATEGORICAL)))
def unknown_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = label_dictionary(label_model(spark, sf_dir))
    return find_unknown(credit_dirty(spark, sf_dir), label_frame(spark, labels))


_NEEDED_SQL = [c for c in CONTRACT if c not in IMPUTED and c != "loan_percent_income"]


REPORT_CTE = (
    ", found AS ("
    + " UNION ALL ".join(
        [
            f"SELECT 'error' AS level, 'type_incompatible' AS kind, '{c}' AS column_name, CAST(NULL AS VARCHAR) AS value, "
            f"CAST(NULL AS VARCHAR) AS allowed, COUNT(*) AS n FROM credit_dirty "
            f"WHERE {c} IS NOT NULL AND TRY_CAST(TRIM({c}) AS DOUBLE) IS NULL"
            for c in NUMERIC
        ]
        + [
            f"SELECT 'warning', 'valeur_manquante', '{c}', NULL, NULL, COUNT(*) FROM credit_dirty WHERE {c} IS NULL"
            for c in _NEEDED_SQL
        ]
        + [
            f"SELECT 'error', 'categorie_inconnue', column_name, value, "
            f"(SELECT STRING_AGG(DISTINCT {c}, ', ' ORDER BY {c}) FROM credit), n FROM ({_unknown_sql([c])})"
            for c in CATEGORICAL
        ]
    )
    + ")"
)
REPORT_SELECT = """SELECT * FROM found WHERE n > 0
UNION ALL SELECT 'warning', 'colonnes_ignorées', 'note', NULL, NULL, 1
UNION ALL SELECT 'verdict', (SELECT CASE WHEN COUNT(*) = 0 THEN 'compatible' ELSE 'incompatible' END
  FROM found WHERE level = 'error' AND n > 0), NULL, NULL, NULL, COUNT(*) FROM credit_dirty"""


@query(over_dirty(f"{REPORT_CTE}\n{REPORT_SELECT}"))
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(credit_dirty(spark, sf_dir), label_dictionary(label_model(spark, sf_dir)), KEY)


@query(over_credit("SELECT 'verdict' AS level, 'compatible' AS kind, CAST(NULL AS VARCHAR) AS column_name, "
                   "CAST(NULL AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS allowed, COUNT(*) AS n FROM credit"))  # fmt: skip
def validation_report_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(credit(spark, sf_dir), label_dictionary(label_model(spark, sf_dir)), KEY)


@query(
    over_dirty(
        """SELECT k AS application_id, 'type_incompatible:person_income' AS reason FROM credit_dirty WHERE k % 50 = 1
UNION ALL SELECT k, 'type_incompatible:loan_amnt' FROM credit_dirty WHERE k % 60 = 2
UNION ALL SELECT k, 'valeur_manquante:person_home_ownership' FROM credit_dirty WHERE person_home_ownership IS NULL
UNION ALL SELECT k, 'valeur_manquante:person_age' FROM credit_dirty WHERE person_age IS NULL
UNION ALL SELECT k, 'categorie_inconnue:loan_intent' FROM credit_dirty WHERE loan_intent = 'WEDDING'"""
    )
)
def score_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejects = score(forest_model(spark, sf_dir), credit_dirty(spark, sf_dir))
    return rejects.select(F.col(KEY).try_cast("bigint").alias(KEY), F.explode("reasons").alias("reason"))


@query(
    over_dirty(
        """SELECT COUNT(*) AS n_rows FROM credit_dirty WHERE NOT (k % 50 = 1 OR k % 60 = 2 OR k % 70 = 3
  OR k % 80 = 4 OR k % 90 = 5)"""
    )
)
def score_usable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = score(forest_model(spark, sf_dir), credit_dirty(spark, sf_dir))
    return score_summary(scored).select("n_rows")
