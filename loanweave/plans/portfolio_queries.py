"""Queries over the portfolio: sources, filters, indicators, profiles, bands, samples, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ALERT_POLICY, DIAL_POLICY, REVIEW_POLICY, blank_to_null, decision, risk_band, to_number
from ..operators import (
    FilterSpec,
    apply_filters,
    auc,
    bounds,
    box_stats,
    confusion,
    counts,
    describe_numeric,
    describe_text,
    distinct_values,
    drop_outliers,
    first_rows,
    histogram,
    is_train,
    join_truth,
    level_counts,
    portfolio_kpis as kpis,
    sample_n,
    schema_report as report_schema,
    summary_quartiles as quartiles,
    with_folds,
    with_stratified_split,
)
from ..schema import APPLICATION_SCHEMA, CATEGORICAL, COLUMNS, CONTRACT, KEY, LABEL, NUMERIC
from ..session import scratch_path
from ..sources import credit, credit_dirty, export_csv, read_applications, read_text, table
from .catalog import BUCKET_SQL, FOLD_SQL, over_credit, over_dirty, query
from .tuning import grid, search_plan

ALL = ", ".join(COLUMNS)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- sources -----------------------------------------------------------------------------------------------------


@query(over_credit(f"SELECT {ALL} FROM credit"))
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = export_csv(credit(spark, sf_dir), scratch_path(spark, "csv"))
    return read_applications(spark, path)


@query(over_credit(f"SELECT application_id, {', '.join(CONTRACT)} FROM credit"))
def project_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credit(spark, sf_dir).select(KEY, *CONTRACT)


@query(
    over_credit(
        " UNION ALL ".join(
            f"SELECT {i} AS position, '{f.name}' AS column_name, '{f.dataType.simpleString()}' AS column_type, "
            f"COUNT(*) AS n_rows, COUNT(*) - COUNT({f.name}) AS n_missing FROM credit"
            for i, f in enumerate(APPLICATION_SCHEMA)
        )
    )
)
def schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_schema(credit(spark, sf_dir))


# --- filters -----------------------------------------------------------------------------------------------------


@query(over_credit(f"SELECT {ALL} FROM credit WHERE person_age <= 100 AND person_emp_length <= 50"))
def filter_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_outliers(credit(spark, sf_dir))


@query(
    over_credit(
        "SELECT application_id, person_home_ownership, loan_intent FROM credit "
        "WHERE person_home_ownership IN ('RENT', 'OWN') AND loan_intent IN ('MEDICAL', 'VENTURE')"
    )
)
def filter_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = FilterSpec(members={"person_home_ownership": ["RENT", "OWN"], "loan_intent": ["MEDICAL", "VENTURE"]})
    return apply_filters(credit(spark, sf_dir, [KEY, "person_home_ownership", "loan_intent"]), spec)


@query(over_credit("SELECT application_id, person_age FROM credit WHERE person_age BETWEEN 25 AND 40"))
def filter_age_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_filters(credit(spark, sf_dir, [KEY, "person_age"]), FilterSpec(ranges={"person_age": (25, 40)}))


@query(
    over_credit(
        "SELECT application_id, person_home_ownership, loan_intent, cb_person_default_on_file FROM credit "
        "WHERE person_home_ownership = 'MORTGAGE' AND cb_person_default_on_file = 'Y'"
    )
)
def filter_optional_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = FilterSpec(
        equals={
            "person_home_ownership": "MORTGAGE",
            "loan_intent": None,
            "cb_person_default_on_file": "Y",
            "no_such_column": "1",
        }
    )
    return apply_filters(credit(spark, sf_dir, [KEY, *CATEGORICAL]), spec)


PORTFOLIO = FilterSpec(
    members={
        "person_home_ownership": ["RENT", "OWN", "MORTGAGE"],
        "loan_intent": ["PERSONAL", "EDUCATION", "MEDICAL", "HOMEIMPROVEMENT", "DEBTCONSOLIDATION"],
    },
    ranges={"person_age": (22, 60)},
)
PORTFOLIO_SQL = """person_age <= 100 AND person_emp_length <= 50
  AND person_home_ownership IN ('RENT', 'OWN', 'MORTGAGE')
  AND loan_intent IN ('PERSONAL', 'EDUCATION', 'MEDICAL', 'HOMEIMPROVEMENT', 'DEBTCONSOLIDATION')
  AND person_age BETWEEN 22 AND 60"""
KPI_SQL = """SELECT COUNT(*) AS total, COALESCE(CAST(SUM(loan_status) AS BIGINT), 0) AS n_default,
  ROUND(COALESCE(SUM(loan_status) * 1.0 / NULLIF(COUNT(*), 0), 0) * 100, 6) AS default_rate_pct,
  ROUND(COALESCE(AVG(person_income), 0), 6) AS mean_income, ROUND(COALESCE(AVG(loan_amnt), 0), 6) AS mean_loan
FROM credit WHERE """
KPI_COLUMNS = [
    "person_age", "person_emp_length", "person_home_ownership", "loan_intent", "person_income", "loan_amnt", LABEL,
]


def portfolio(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    """The dashboard's selection: no outliers, and the filter set."""
    return apply_filters(drop_outliers(credit(spark, sf_dir, columns)), PORTFOLIO)


@query(over_credit(f"SELECT {ALL} FROM credit WHERE {PORTFOLIO_SQL}"))
def filter_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio(spark, sf_dir)


@query(
    over_dirty(
        """SELECT k AS application_id, TRY_CAST(TRIM(person_income) AS DOUBLE) AS person_income,
  TRY_CAST(TRIM(loan_amnt) AS DOUBLE) AS loan_amnt, TRY_CAST(TRIM(person_emp_length) AS DOUBLE) AS person_emp_length,
  NULLIF(TRIM(person_home_ownership), '') AS person_home_ownership FROM credit_dirty"""
    )
)
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = ("person_income", "loan_amnt", "person_emp_length")
    return credit_dirty(spark, sf_dir).select(
        F.col(KEY).try_cast("bigint").alias(KEY),
        *[to_number(F.col(c)).alias(c) for c in numbers],
        blank_to_null(F.col("person_home_ownership")).alias("person_home_ownership"),
    )


# --- indicators --------------------------------------------------------------------------------------------------


def _kpis(df: DataFrame) -> DataFrame:
    return _rounded(kpis(df), "default_rate_pct", "mean_income", "mean_loan")


@query(over_credit(KPI_SQL + PORTFOLIO_SQL))
def portfolio_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kpis(portfolio(spark, sf_dir, KPI_COLUMNS))


@query(over_credit(KPI_SQL + "person_age BETWEEN 200 AND 300"))
def portfolio_kpis_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    nobody = FilterSpec(ranges={"person_age": (200, 300)})
    return _kpis(apply_filters(credit(spark, sf_dir, KPI_COLUMNS), nobody))


# --- profiles ----------------------------------------------------------------------------------------------------


@query(over_credit("SELECT CAST(MIN(person_age) AS BIGINT) AS low, CAST(MAX(person_age) AS BIGINT) AS high FROM credit"))
def age_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds(credit(spark, sf_dir, ["person_age"]), "person_age")


_MEASURED = (*NUMERIC, LABEL)


@query(
    over_credit(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, COUNT({c}) AS n, ROUND(AVG({c}), 6) AS mean, "
            f"ROUND(STDDEV_SAMP(CAST({c} AS DOUBLE)), 6) AS sd, CAST(MIN({c}) AS DOUBLE) AS min, "
            f"CAST(MAX({c}) AS DOUBLE) AS max FROM credit"
            for c in _MEASURED
        )
    ),
    name="describe_numeric",
)
def describe_numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(describe_numeric(credit(spark, sf_dir, _MEASURED), _MEASURED), "mean", "sd")


@query(
    over_credit(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, COUNT({c}) AS n, MIN({c}) AS min, MAX({c}) AS max FROM credit" for c in CATEGORICAL
        )
    ),
    name="describe_text",
)
def describe_text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_text(credit(spark, sf_dir, CATEGORICAL), CATEGORICAL)


@query(
    over_credit(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, CAST(MIN({c}) AS DOUBLE) AS min, "
            f"ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25), 6) AS q1, "
            f"ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.5), 6) AS median, ROUND(AVG({c}), 6) AS mean, "
            f"ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75), 6) AS q3, CAST(MAX({c}) AS DOUBLE) AS max FROM credit"
            for c in NUMERIC
        )
    )
)
def summary_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quartiles(credit(spark, sf_dir, NUMERIC), NUMERIC), "q1", "median", "mean", "q3")


@query(
    over_credit(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, {c} AS level, COUNT(*) AS n FROM credit GROUP BY {c}" for c in CATEGORICAL
        )
    )
)
def factor_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_counts(credit(spark, sf_dir, CATEGORICAL), CATEGORICAL)


def _share_sql(source: str, *keys: str) -> str:
    names = ", ".join(keys)
    return f"SELECT {names}, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share FROM {source} GROUP BY {names}"


@query(over_credit(_share_sql("credit", LABEL)))
def status_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(counts(credit(spark, sf_dir, [LABEL]), [LABEL], share=True), "share")


@query(over_credit("SELECT loan_intent, loan_status, COUNT(*) AS n FROM credit GROUP BY loan_intent, loan_status"))
def default_by_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["loan_intent", LABEL]
    return counts(credit(spark, sf_dir, keys), keys)


@query(over_credit(_share_sql("credit", "person_home_ownership")))
def ownership_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["person_home_ownership"]
    return _rounded(counts(credit(spark, sf_dir, keys), keys, share=True), "share")


@query(over_credit("SELECT loan_intent, COUNT(*) AS n FROM credit GROUP BY loan_intent"))
def intent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(credit(spark, sf_dir, ["loan_intent"]), ["loan_intent"])


@query(_share_sql("embeddings", "label"))
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(counts(table(spark, sf_dir, "embeddings"), ["label"], share=True), "share")


@query(
    over_credit(
        "SELECT person_home_ownership, loan_status, COUNT(*) AS n FROM credit GROUP BY person_home_ownership, loan_status"
    )
)
def ownership_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["person_home_ownership", LABEL]
    return counts(credit(spark, sf_dir, keys), keys)


def _histogram_sql(column: str, bins: int) -> str:
    index = f"CASE WHEN w = 0 THEN 0 ELSE CAST(LEAST(FLOOR((v - lo) / w), {bins - 1}) AS INT) END"
    return f""",
v AS (SELECT CAST({column} AS DOUBLE) AS v FROM credit WHERE {column} IS NOT NULL),
b AS (SELECT MIN(v) AS lo, MAX(v) AS hi, (MAX(v) - MIN(v)) / {bins} AS w FROM v),
t AS (SELECT {index} AS bin, COUNT(*) AS n FROM v, b GROUP BY 1)
SELECT CAST(r.bin AS INT) AS bin, ROUND(lo + r.bin * w, 6) AS bin_low, ROUND(lo + (r.bin + 1) * w, 6) AS bin_high,
  COALESCE(t.n, 0) AS n
FROM range({bins}) AS r(bin) CROSS JOIN b LEFT JOIN t ON t.bin = r.bin"""


@query(over_credit(_histogram_sql("loan_amnt", 30)))
def histogram_loan_amnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(histogram(credit(spark, sf_dir, ["loan_amnt"]), "loan_amnt"), "bin_low", "bin_high")


@query(over_credit(_histogram_sql(LABEL, 30)))
def histogram_loan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(histogram(credit(spark, sf_dir, [LABEL]), LABEL), "bin_low", "bin_high")


def _box_sql(columns) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, loan_status, CAST({c} AS DOUBLE) AS v FROM credit WHERE {c} IS NOT NULL"
        for c in columns
    )
    return f""",
long AS ({long}),
q AS (SELECT feature, loan_status, QUANTILE_CONT(v, 0.25) AS q1, QUANTILE_CONT(v, 0.5) AS median,
        QUANTILE_CONT(v, 0.75) AS q3 FROM long GROUP BY feature, loan_status),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT feature, loan_status, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3, COUNT(*) AS n,
  MIN(v) FILTER (v BETWEEN lo AND hi) AS whisker_low, MAX(v) FILTER (v BETWEEN lo AND hi) AS whisker_high,
  COUNT(*) FILTER (NOT v BETWEEN lo AND hi) AS n_outliers
FROM long JOIN f USING (feature, loan_status) GROUP BY feature, loan_status, q1, median, q3"""


# The numeric features compared by loan status; the one text feature is tallied by ownership_by_status.
BOX_FEATURES = (
    "person_age",
    "person_income",
    "person_emp_length",
    "loan_int_rate",
    "loan_percent_income",
    "cb_person_cred_hist_length",
)


@query(over_credit(_box_sql(["loan_int_rate"])))
def box_int_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["loan_int_rate"]
    return _rounded(box_stats(credit(spark, sf_dir, [*columns, LABEL]), columns), "q1", "median", "q3")


@query(over_credit(_box_sql(BOX_FEATURES)))
def box_all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(box_stats(credit(spark, sf_dir, [*BOX_FEATURES, LABEL]), BOX_FEATURES), "q1", "median", "q3")


@query(
    over_credit(
        " UNION ALL ".join(
            f'SELECT DISTINCT \'{c}\' AS column_name, {c} AS "option" FROM credit WHERE {c} IS NOT NULL'
            for c in CATEGORICAL
        )
    )
)
def filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_values(credit(spark, sf_dir, CATEGORICAL), CATEGORICAL)


@query(over_credit(f"SELECT {ALL} FROM credit ORDER BY application_id LIMIT 6"))
def preview_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_rows(credit(spark, sf_dir), 6, KEY)


@query(
    over_credit(
        f"""SELECT application_id, person_income, loan_amnt, CAST(loan_status AS VARCHAR) AS status
FROM credit WHERE {PORTFOLIO_SQL}
ORDER BY md5(concat(CAST(application_id AS VARCHAR), '-42')), application_id LIMIT 2000"""
    )
)
def scatter_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [KEY, *KPI_COLUMNS]
    return sample_n(portfolio(spark, sf_dir, columns), 2000, seed=42).select(
        KEY, "person_income", "loan_amnt", F.col(LABEL).cast("string").alias("status")
    )


@query(over_credit("SELECT application_id, person_income, loan_amnt, loan_intent FROM credit"))
def scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credit(spark, sf_dir, [KEY, "person_income", "loan_amnt", "loan_intent"])


# --- bands, rule-based predictions -------------------------------------------------------------------------------


@query(
    over_credit(
        """SELECT application_id, loan_percent_income AS score, CASE WHEN loan_percent_income < 0.30 THEN 'accept'
  WHEN loan_percent_income < 0.50 THEN 'review' ELSE 'refuse' END AS band FROM credit"""
    )
)
def risk_bands_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("loan_percent_income")
    return credit(spark, sf_dir, [KEY, "loan_percent_income"]).select(
        KEY, score.alias("score"), risk_band(score, REVIEW_POLICY).alias("band")
    )


@query(
    over_credit(
        """SELECT application_id, loan_percent_income AS score, CASE WHEN loan_percent_income < 0.30 THEN 'low'
  WHEN loan_percent_income < 0.60 THEN 'moderate' ELSE 'high' END AS band,
  CASE WHEN loan_percent_income > 0.5 THEN 'default' ELSE 'no default' END AS decision FROM credit"""
    )
)
def risk_bands_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("loan_percent_income")
    return credit(spark, sf_dir, [KEY, "loan_percent_income"]).select(
        KEY,
        score.alias("score"),
        risk_band(score, ALERT_POLICY).alias("band"),
        decision((score > 0.5).cast("int")).alias("decision"),
    )


@query(
    over_credit(
        """SELECT CASE WHEN loan_percent_income * 100 < 30 THEN 'green' WHEN loan_percent_income * 100 < 60 THEN 'amber'
  ELSE 'red' END AS step, COUNT(*) AS n FROM credit GROUP BY 1"""
    )
)
def dial_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    percent = F.col("loan_percent_income") * 100
    rows = credit(spark, sf_dir, ["loan_percent_income"])
    return counts(rows.select(risk_band(percent, DIAL_POLICY).alias("step")), ["step"])


def rule_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, score, prediction) by a rule that SQL can state: a loan above half an income defaults."""
    score = F.col("loan_percent_income")
    return credit(spark, sf_dir, [KEY, "loan_percent_income"]).select(
        KEY, score.alias("score"), (score > 0.5).cast("int").alias("prediction")
    )


def rule_with_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_truth(rule_predictions(spark, sf_dir), credit(spark, sf_dir, [KEY, LABEL]))


@query(
    over_credit(
        """SELECT application_id, loan_percent_income AS score, CAST(loan_percent_income > 0.5 AS INT) AS prediction,
  loan_status FROM credit"""
    ),
    name="join_truth",
)
def truth_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_with_truth(spark, sf_dir)


@query(
    over_credit(
        """SELECT loan_status AS truth, COUNT(*) FILTER (NOT loan_percent_income > 0.5) AS pred_0,
  COUNT(*) FILTER (loan_percent_income > 0.5) AS pred_1, COUNT(*) FILTER (loan_percent_income IS NULL) AS pred_other
FROM credit GROUP BY loan_status"""
    )
)
def confusion_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = credit(spark, sf_dir, ["loan_percent_income", LABEL])
    rule = (F.col("loan_percent_income") > 0.5).cast("int")
    return confusion(rows.withColumn("prediction", rule), LABEL, "prediction", [0, 1])


@query(
    over_credit(
        """,
r AS (SELECT loan_status AS y, RANK() OVER (ORDER BY loan_percent_income)
        + (COUNT(*) OVER (PARTITION BY loan_percent_income) - 1) / 2.0 AS rk FROM credit),
s AS (SELECT SUM(rk) FILTER (y = 1) AS sum_rk, COUNT(*) FILTER (y = 1) * 1.0 AS p, COUNT(*) FILTER (y = 0) * 1.0 AS n
      FROM r)
SELECT ROUND((sum_rk - p * (p + 1) / 2) / (p * n), 6) AS area_under_roc FROM s"""
    )
)
def auc_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = auc(credit(spark, sf_dir, ["loan_percent_income", LABEL]), "loan_percent_income")
    return spark.createDataFrame([(value,)], "area_under_roc double").select(
        F.round("area_under_roc", 6).alias("area_under_roc")
    )


# --- quoted text -------------------------------------------------------------------------------------------------


@query(
    over_credit(
        """SELECT application_id, CASE WHEN application_id % 41 <> 0 THEN loan_intent END AS loan_intent,
  'said "' || loan_intent || '", then' || chr(10) || CAST(application_id AS VARCHAR) AS note FROM credit"""
    )
)
def csv_dirty_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, commas, line breaks and missing markers, exported and read back."""
    key, intent = F.col(KEY), F.col("loan_intent")
    note = F.concat(F.lit('said "'), intent, F.lit('", then\n'), key.cast("string"))
    rows = credit(spark, sf_dir, [KEY, "loan_intent"]).select(
        KEY, F.when(key % 41 == 0, "NA").otherwise(intent).alias("loan_intent"), note.alias("note")
    )
    path = export_csv(rows, scratch_path(spark, "quoted"))
    return read_text(spark, path, multiline=True).withColumn(KEY, key.cast("bigint"))


# --- splits ------------------------------------------------------------------------------------------------------


@query(
    over_credit(
        f"SELECT CASE WHEN {BUCKET_SQL} < 800 THEN 'train' ELSE 'test' END AS part, COUNT(*) AS n FROM credit GROUP BY 1"
    )
)
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(is_train(), "train").otherwise("test").alias("part")
    return counts(credit(spark, sf_dir, [KEY]).select(part), ["part"])


@query(
    over_credit(
        """,
h AS (SELECT application_id, loan_status,
        ROW_NUMBER() OVER (PARTITION BY loan_status ORDER BY
          SUBSTR(MD5(CONCAT(CAST(application_id AS VARCHAR), '-123')), 1, 13), application_id) AS rn,
        COUNT(*) OVER (PARTITION BY loan_status) AS size FROM credit)
SELECT application_id, loan_status, rn <= CEIL(0.75 * size) AS is_train FROM h"""
    )
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_stratified_split(credit(spark, sf_dir, [KEY, LABEL]), LABEL)


@query(
    over_credit(
        f"""SELECT {FOLD_SQL} AS fold, COUNT(*) AS n,
  CAST(SUM(loan_status) AS BIGINT) AS n_default FROM credit WHERE {BUCKET_SQL} < 800 GROUP BY 1"""
    )
)
def fold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = credit(spark, sf_dir, [KEY, LABEL]).filter(is_train())
    return with_folds(train, 5).groupBy("fold").agg(F.count("*").alias("n"), F.sum(LABEL).alias("n_default"))


@query(
    over_credit(
        f""",
g AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY t, d, i) - 1 AS INT) AS point, t AS num_trees, d AS max_depth, i AS impurity
      FROM (VALUES (20), (50), (100)) a(t), (VALUES (3), (5), (10)) b(d), (VALUES ('entropy'), ('gini')) c(i)),
f AS (SELECT {FOLD_SQL} AS fold, COUNT(*) AS n_valid
      FROM credit WHERE {BUCKET_SQL} < 800 GROUP BY 1)
SELECT point, num_trees, max_depth, impurity, fold, CAST((SELECT SUM(n_valid) FROM f) AS BIGINT) - n_valid AS n_train, n_valid
FROM g, f"""
    ),
    name="param_grid",
)
def cv_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_plan(credit(spark, sf_dir, [KEY]).filter(is_train()), grid(), folds=5)
