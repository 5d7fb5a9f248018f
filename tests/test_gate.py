"""One read validates and scores; the report is that of ``validate``."""

from pyspark.sql import functions as F

from loanweave.operators import is_compatible, validate
from loanweave.plans.features import label_dictionary
from loanweave.plans.gate import answered, gate_and_score
from loanweave.plans.scoring import score
from loanweave.schema import KEY
from loanweave.sources import credit_dirty

from .conftest import SF


def rows_of(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_refused_table(spark, model):
    dirty = credit_dirty(spark, SF)
    gated = gate_and_score(model, dirty)
    assert not gated.compatible and gated.scored is None and gated.rejects is None
    assert rows_of(gated.report) == rows_of(validate(dirty, label_dictionary(model), KEY))


def test_passed_table_equals_separate_steps(spark, model, loans):
    holes = loans.withColumn("person_age", F.when(F.col(KEY) % 9 != 5, F.col("person_age")))
    gated = gate_and_score(model, holes)
    assert gated.compatible and is_compatible(gated.report)
    assert rows_of(gated.report) == rows_of(validate(holes, label_dictionary(model), KEY))
    scored, rejects = score(model, holes)
    assert gated.scored.columns == scored.columns and rows_of(gated.scored) == rows_of(scored)
    assert rows_of(gated.rejects) == rows_of(rejects)


def test_numbers_as_text_and_blank_categories(spark, model, loans):
    text = loans.limit(40).select(*[F.col(c).cast("string").alias(c) for c in loans.columns])
    odd = text.withColumn("loan_intent", F.when(F.col(KEY) % 2 == 0, F.lit(" ")).otherwise(F.col("loan_intent")))
    assert rows_of(gate_and_score(model, odd).report) == rows_of(validate(odd, label_dictionary(model), KEY))
    assert rows_of(gate_and_score(model, text).scored) == rows_of(score(model, text)[0])


def test_one_scan_per_input_file(spark, model, tmp_path, loans):
    loans.write.parquet(str(tmp_path / "in"))
    plan = answered(model, spark.read.parquet(str(tmp_path / "in")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan and "Union" not in plan


def test_empty_table_and_missing_columns(spark, model, loans):
    empty = gate_and_score(model, loans.limit(0))
    assert empty.compatible and empty.scored.count() == 0 and empty.rejects.count() == 0
    assert empty.report.first()["n"] == 0
    lacking = loans.drop("loan_amnt")
    refused = gate_and_score(model, lacking)
    assert not refused.compatible and rows_of(refused.report) == rows_of(validate(lacking, label_dictionary(model), KEY))
