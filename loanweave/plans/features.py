"""The feature and model stages."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import (
    Imputer,
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.sql import DataFrame, SparkSession

from ..operators.profile import melt
from ..operators.quantiles import exact_quantiles
from ..operators.validation import label_frame
from ..schema import CATEGORICAL, IMPUTED, LABEL
from ..session import written

SEED = 123

IMPUTED_NAMES = {c: f"imp_{c}" for c in IMPUTED}
INDEXED_NAMES = {c: f"idx_{c}" for c in CATEGORICAL}
ENCODED_NAMES = {c: f"hot_{c}" for c in CATEGORICAL}

# Fixed order of the model's inputs: 6 numbers and 3 one-hot vectors, 15 positions on the full category domains.
MODEL_INPUTS = (
    "person_age",
    "person_income",
    "imp_person_emp_length",
    "imp_loan_int_rate",
    "hot_person_home_ownership",
    "hot_loan_intent",
    "hot_cb_person_default_on_file",
    "loan_amnt",
    "cb_person_cred_hist_length",
)


@dataclass(frozen=True)
class ForestParams:
    """Random-forest settings; the defaults are the untuned model's."""

    num_trees: int = 20
    max_depth: int = 5
    impurity: str = "gini"
    seed: int = SEED
    max_memory_mb: int = 256  # for one pass's split statistics; more of it means fewer passes for deep forests


# The tuned model.
TUNED = ForestParams(num_trees=100, max_depth=10, impurity="entropy")


def exact_medians(df: DataFrame) -> dict[str, float]:
    """The middle observed value of each imputed column, exact at any size."""
    rows = exact_quantiles(melt(written(df.select(*IMPUTED), "medians"), IMPUTED), "value", ["feature"], [0.5], interpolate=False).collect()
    medians = {r["feature"]: r["q"][0] for r in rows}
    if empty := set(IMPUTED) - set(medians):
        raise ValueError(f"no value to impute from in {sorted(empty)}")
    return medians


def median_filler(medians: Mapping[str, float]) -> SQLTransformer:
    """A stage that fills given medians in; saved and loaded like any other."""
    filled = [f"coalesce(nanvl({c}, NULL), {medians[c]!r}D) AS {IMPUTED_NAMES[c]}" for c in IMPUTED]
    return SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__")


def label_indexer() -> StringIndexer:
    """Labels by falling frequency, ties by name; one stage, so that all categories are counted in one pass."""
    return StringIndexer(
        inputCols=list(CATEGORICAL),
        outputCols=[INDEXED_NAMES[c] for c in CATEGORICAL],
        stringOrderType="frequencyDesc",
        handleInvalid="error",
    )


def label_encoder() -> OneHotEncoder:
    return OneHotEncoder(
        inputCols=[INDEXED_NAMES[c] for c in CATEGORICAL], outputCols=[ENCODED_NAMES[c] for c in CATEGORICAL], dropLast=True
    )


def fit_labels(df: DataFrame) -> PipelineModel:
    """The label indexer alone: all that validation needs of a model, from three columns."""
    return Pipeline(stages=[label_indexer()]).fit(df.select(*CATEGORICAL))


def feature_stages(relative_error: float = 0.001, medians: Mapping[str, float] | None = None) -> list:
    """Median imputation, label indexing, one-hot encoding, assembly and scaling.

    The medians are sketched with a rank error of at most ``relative_error``, unless given.
    """
    if medians is None:
        imputation = Imputer(
            strategy="median",
            inputCols=list(IMPUTED),
            outputCols=[IMPUTED_NAMES[c] for c in IMPUTED],
            relativeError=relative_error,
        )
    else:
        imputation = median_filler(medians)
    return [
        imputation,
        label_indexer(),
        label_encoder(),
        VectorAssembler(inputCols=list(MODEL_INPUTS), outputCol="features", handleInvalid="error"),
        StandardScaler(inputCol="features", outputCol="features_scaler", withMean=False, withStd=True),
    ]


def forest(params: ForestParams = ForestParams()) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="features_scaler",
        labelCol=LABEL,
        numTrees=params.num_trees,
        maxDepth=params.max_depth,
        impurity=params.impurity,
        seed=params.seed,
        maxMemoryInMB=params.max_memory_mb,
    )


def build_pipeline(params: ForestParams = ForestParams(), relative_error: float = 0.001) -> Pipeline:
    return Pipeline(stages=[*feature_stages(relative_error), forest(params)])


def label_dictionary(model: PipelineModel) -> dict[str, list[str]]:
    """Category column -> labels in index order, from the fitted indexers."""
    found: dict[str, list[str]] = {}
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel):
            columns = stage.getInputCols() if stage.isSet("inputCols") else [stage.getInputCol()]
            found.update({c: [str(v) for v in labels] for c, labels in zip(columns, stage.labelsArray)})
    return found


def label_table(model: PipelineModel, spark: SparkSession) -> DataFrame:
    return label_frame(spark, label_dictionary(model))


def model_text(model: PipelineModel) -> str:
    """The fitted trees (or tree) as text."""
    return model.stages[-1].toDebugString


def model_params(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """Every parameter of every fitted stage: (stage, kind, param, value)."""
    rows = [
        (i, type(stage).__name__, param.name, str(stage.getOrDefault(param)))
        for i, stage in enumerate(model.stages)
        for param in stage.params
        if stage.isDefined(param)
    ]
    return spark.createDataFrame(rows, "stage int, kind string, param string, value string")
