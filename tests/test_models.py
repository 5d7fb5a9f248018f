import numpy as np
import pytest
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from loanweave.functions import separate_vector
from loanweave.operators import auc, auc_evaluator, is_train, with_folds
from loanweave.plans.features import (
    TUNED,
    ForestParams,
    build_pipeline,
    exact_medians,
    feature_stages,
    label_dictionary,
    model_text,
)
from loanweave.plans.model_queries import MULTIPLE, held_out_part
from loanweave.plans.training import coefficients, fit_linear, load, save, train
from loanweave.plans.features import forest
from loanweave.plans.tuning import areas, cross_validate, grid, keeps_node_ids, param_maps, search_partitions, training_rows, tune
from loanweave.schema import KEY, LABEL

from .conftest import SF


def predictions(model, df):
    return separate_vector(model.transform(df), "probability", ["p0", "p1"]).select(KEY, LABEL, "p0", "p1", "prediction")


def test_probabilities_and_classes_agree(spark, model):
    rows = predictions(model, held_out_part(spark, SF)).collect()
    assert rows
    assert all(0 <= r["p1"] <= 1 and r["p0"] + r["p1"] == pytest.approx(1) for r in rows)
    assert all((r["prediction"] == 1) == (r["p1"] > 0.5) for r in rows)


def test_the_model_separates_the_classes(spark, model):
    assert auc(model.transform(held_out_part(spark, SF))) > 0.8


def test_refit_gives_the_same_model_whatever_the_layout(loans, model):
    again = train(loans.repartition(5).filter(is_train()))
    one = {r[KEY]: r["p1"] for r in predictions(model, loans).collect()}
    two = {r[KEY]: r["p1"] for r in predictions(again, loans).collect()}
    assert max(abs(one[k] - two[k]) for k in one) < 1e-9


def test_model_shape(model):
    forest = model.stages[-1]
    assert forest.numFeatures == 15 and forest.numClasses == 2 and forest.getNumTrees == 20
    assert (TUNED.num_trees, TUNED.max_depth, TUNED.impurity) == (100, 10, "entropy")


def test_labels_by_frequency(model, loans):
    train_rows = loans.filter(is_train())
    order = train_rows.groupBy("loan_intent").count().orderBy(F.desc("count"), "loan_intent").collect()
    assert label_dictionary(model)["loan_intent"] == [r["loan_intent"] for r in order]


def test_save_and_load(model, loans, tmp_path):
    save(model, str(tmp_path / "m"))
    save(model, str(tmp_path / "m"))  # overwrites
    assert predictions(load(str(tmp_path / "m")), loans).exceptAll(predictions(model, loans)).count() == 0


def test_auc_by_hand(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1)], "score double, loan_status int")
    assert auc(df, "score") == pytest.approx((1 + 0.5 + 1 + 1) / 4)


def test_linear_model_equals_least_squares(loans):
    model = fit_linear(loans, MULTIPLE)
    got = {r["term"]: r["coefficient"] for r in coefficients(model, loans).collect()}
    names = ["person_income", "person_age", "loan_percent_income"]
    pdf = loans.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf[names].to_numpy(float)])
    expected, *_ = np.linalg.lstsq(x, pdf["loan_amnt"].to_numpy(float), rcond=None)
    assert [got[n] for n in ["(intercept)", *names]] == pytest.approx(list(expected), rel=1e-6)


def test_grid():
    points = grid()
    assert len(points) == len(set(points)) == 18
    assert ForestParams(100, 10, "entropy") in points


def test_search_equals_the_built_in_cross_validator(loans):
    """Sharing the feature stages among grid points must not change any score."""
    points = grid(num_trees=(3,), max_depth=(2, 4), impurity=("gini",))
    rows = loans.filter(is_train())
    shared = cross_validate(rows, points, folds=2)
    pipeline = build_pipeline()
    whole = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=param_maps(points, pipeline.getStages()[-1]),
        evaluator=auc_evaluator(),
        numFolds=2,
        foldCol="fold",
    )
    ordered = with_folds(rows, 2).repartition(KEY).sortWithinPartitions(KEY)
    assert shared == pytest.approx(whole.fit(ordered).avgMetrics, abs=1e-9)


def test_tuning_returns_the_best_point_refitted(loans):
    points = grid(num_trees=(2, 6), max_depth=(1, 4), impurity=("gini",))
    best, metrics = tune(loans.filter(is_train()), points, folds=2)
    rows = metrics.collect()
    assert [r["area_under_roc"] for r in rows] == sorted((r["area_under_roc"] for r in rows), reverse=True)
    forest = best.stages[-1]
    assert (forest.getNumTrees, forest.getMaxDepth()) == (rows[0]["num_trees"], rows[0]["max_depth"])


def test_exact_medians_equal_the_imputers_without_error(loans):
    imputer = feature_stages(relative_error=0.0)[0]
    assert exact_medians(loans) == imputer.fit(loans).surrogateDF.first().asDict()


def test_nothing_to_impute_from(loans):
    with pytest.raises(ValueError, match="loan_int_rate"):
        exact_medians(loans.withColumn("loan_int_rate", F.lit(None).cast("double")))


def test_tree_text(model):
    assert "If (feature" in model_text(model)


def test_stage_order():
    kinds = [type(s).__name__ for s in feature_stages()]
    assert kinds == ["Imputer", "StringIndexer", "OneHotEncoder", "VectorAssembler", "StandardScaler"]


def test_a_search_keeps_few_rows_in_few_partitions(spark, loans):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "64")
    try:
        with training_rows(loans, 5) as (rows, n_rows):
            assert rows.rdd.getNumPartitions() == 8
            assert n_rows == rows.count() == loans.count()
    finally:
        spark.conf.set(name, before)
    assert [search_partitions(n, 200) for n in (0, 1_000_000, 10**9)] == [8, 20, 200]
    assert search_partitions(1_000_000, 4) == 4


def test_models_are_scored_side_by_side(loans, capsys):
    rows = build_pipeline().fit(loans).transform(loans).select("features_scaler", LABEL).cache()
    models = [forest(ForestParams(2, 1 + i, "gini")).setCacheNodeIds(bool(i)).fit(rows) for i in range(3)]
    assert areas(models, rows) == pytest.approx({i: auc(m.transform(rows)) for i, m in enumerate(models)}, abs=1e-12)
    assert areas(models, rows.filter(F.col(LABEL) == 1)) == {0: 0.0, 1: 0.0, 2: 0.0}
    rows.unpersist()


def test_kept_node_ids_do_not_change_a_forest(loans):
    rows = build_pipeline().fit(loans).transform(loans).select("features_scaler", LABEL).cache()
    kept, walked = (forest(ForestParams(5, 10, "entropy")).setCacheNodeIds(c).fit(rows).toDebugString for c in (True, False))
    assert kept.split("\n", 1)[1] == walked.split("\n", 1)[1]
    assert keeps_node_ids(95_863, 100) and not keeps_node_ids(7_200_000, 100)
    rows.unpersist()
