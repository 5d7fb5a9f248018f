import pytest
from pyspark.sql import functions as F

from loanweave.operators import check_columns, confusion, is_compatible, label_frame, unknown_categories, validate
from loanweave.plans.features import label_dictionary
from loanweave.plans.model_queries import held_out_part
from loanweave.plans.scoring import score, score_applicants, score_if_compatible, score_summary
from loanweave.schema import KEY
from loanweave.sources import credit_dirty, read_text
from loanweave.streaming import read_stream, score_stream

from .conftest import SF


@pytest.fixture(scope="module")
def labels(model):
    return label_dictionary(model)


def findings(report):
    return {(r["level"], r["kind"], r["column_name"], r["value"], r["n"]) for r in report.collect()}


def test_columns_missing_and_extra():
    found = check_columns(["person_age", "loan_status", "application_id", "note"], key="application_id")
    assert "person_income" in found.missing and "person_age" not in found.missing
    assert found.extra == ["note"]


def test_missing_columns_end_the_check(spark, loans, labels):
    report = validate(loans.drop("person_age", "loan_intent"), labels, KEY)
    assert findings(report) == {
        ("error", "colonnes_manquantes", "person_age", None, 1),
        ("error", "colonnes_manquantes", "loan_intent", None, 1),
        ("verdict", "incompatible", None, None, 1500),
    }
    assert not is_compatible(report)


def test_text_table_is_judged_by_content(spark, tmp_path, labels):
    (tmp_path / "a.csv").write_text(
        "person_age,person_income,person_home_ownership,person_emp_length,loan_intent,loan_amnt,loan_int_rate,"
        "loan_percent_income,cb_person_default_on_file,cb_person_cred_hist_length\n"
        "35,65000,RENT,5,PERSONAL,12000,11.5,0.18,N,8\n"
        "35,12d,RENT,,YACHT,12000,,0.18,N,8\n"
        ",65000,RENT,5,YACHT,12000,11.5,0.18,,8\n"
    )
    assert findings(validate(read_text(spark, str(tmp_path / "a.csv")), labels)) == {
        ("error", "type_incompatible", "person_income", None, 1),
        ("error", "categorie_inconnue", "loan_intent", "YACHT", 2),
        ("warning", "valeur_manquante", "person_age", None, 1),
        ("warning", "valeur_manquante", "cb_person_default_on_file", None, 1),
        ("verdict", "incompatible", None, None, 3),
    }


def test_nan_is_missing_not_bad(spark, applicant, labels):
    nan = applicant.withColumn("person_income", F.lit(float("nan")))
    assert findings(validate(nan, labels)) == {
        ("warning", "valeur_manquante", "person_income", None, 1),
        ("verdict", "compatible", None, None, 1),
    }


def test_categories_are_not_checked_without_labels(spark, applicant):
    odd = applicant.withColumn("loan_intent", F.lit("YACHT"))
    assert is_compatible(validate(odd, {}))
    assert unknown_categories(odd, label_frame(spark, {"person_home_ownership": ["RENT"]})).count() == 0


def test_empty_table_is_compatible(loans, labels):
    assert findings(validate(loans.limit(0), labels, KEY)) == {("verdict", "compatible", None, None, 0)}


def test_gate(spark, loans, model):
    refused = score_if_compatible(model, credit_dirty(spark, SF))
    assert refused.scored is None and not is_compatible(refused.report)
    passed = score_if_compatible(model, loans)
    assert passed.scored.count() == loans.count() and passed.rejects.count() == 0


def test_every_row_is_scored_or_rejected(spark, model):
    dirty = credit_dirty(spark, SF)
    scored, rejects = score(model, dirty)
    assert scored.count() + rejects.count() == dirty.count()
    assert scored.select(KEY).intersect(rejects.select(KEY)).count() == 0
    assert rejects.filter(F.size("reasons") == 0).count() == 0


@pytest.mark.parametrize(
    ("change", "reasons"),
    [
        ({"person_age": None}, ["valeur_manquante:person_age"]),
        ({"person_income": float("nan")}, ["valeur_manquante:person_income"]),
        ({"loan_intent": " "}, ["valeur_manquante:loan_intent"]),
        ({"loan_intent": "YACHT"}, ["categorie_inconnue:loan_intent"]),
        ({"loan_int_rate": None}, None),
        ({"person_emp_length": float("nan")}, None),
        ({"loan_percent_income": None}, None),
    ],
)
def test_reject_rules(applicant, model, change, reasons):
    types = dict(applicant.dtypes)
    odd = applicant.withColumns({c: F.lit(v).cast(types[c]) for c, v in change.items()})
    scored, rejects = score(model, odd)
    assert [r["reasons"] for r in rejects.collect()] == ([] if reasons is None else [reasons])
    assert scored.count() == (1 if reasons is None else 0)


def test_scored_rows_keep_their_columns(model, loans):
    scored, _ = score(model, loans)
    assert scored.select(*loans.columns).exceptAll(loans).count() == 0
    assert scored.columns == [*loans.columns, "prediction", "probability_default", "risk_level", "decision"]


def test_one_applicant(applicant, model):
    row = score_applicants(model, applicant).first()
    assert 0 <= row["probability_default"] <= 1 and row["prediction"] in (0, 1)
    assert round(row["probability_default"], 4) == row["probability_default"]
    assert row["risk_level"] in ("low", "moderate", "high")


def test_the_loan_ratio_is_not_needed(applicant, model):
    with_ratio, without = score_applicants(model, applicant), score_applicants(model, applicant.drop("loan_percent_income"))
    assert with_ratio.first() == without.first()


def test_csv_stream(spark, model, loans, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    loans.write.option("header", True).csv(landing)
    score_stream(model, read_stream(spark, landing, fmt="csv"), out, str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(f"{out}/scored").count() == loans.count()


def test_summary_of_nothing(model, loans):
    scored, _ = score(model, loans.limit(0))
    assert tuple(score_summary(scored).first()) == (0, 0, 0.0)


def test_stream_resumes_without_repeating(spark, model, tmp_path):
    rows = held_out_part(spark, SF)
    landing, out, checkpoint = (str(tmp_path / p) for p in ("landing", "out", "checkpoint"))
    half = F.col(KEY) % 2 == 0
    broken = rows.withColumn("loan_intent", F.when(F.col(KEY) % 10 != 1, F.col("loan_intent")))
    for part in (broken.filter(half), broken.filter(~half)):
        part.write.mode("append").parquet(landing)
        score_stream(model, read_stream(spark, landing), out, checkpoint).awaitTermination()
    scored, rejects = score(model, broken)
    assert rejects.count() > 0
    pick = [KEY, "prediction", "probability_default", "risk_level"]
    streamed = spark.read.parquet(f"{out}/scored").select(*pick)
    assert streamed.exceptAll(scored.select(*pick)).count() == 0
    assert streamed.count() == scored.count()
    assert spark.read.parquet(f"{out}/rejects").count() == rejects.count()


def test_report_lists_what_is_allowed(applicant, labels):
    odd = applicant.withColumn("loan_intent", F.lit("YACHT"))
    row = validate(odd, labels).filter("kind = 'categorie_inconnue'").first()
    assert row["allowed"].split(", ") == sorted(labels["loan_intent"])
    missing = validate(applicant.drop("person_age"), labels).filter("level = 'error'").first()
    assert "person_age" in missing["allowed"].split(", ")


def test_one_scan_for_a_report(spark, loans, labels, tmp_path, capsys):
    loans.write.option("header", True).csv(str(tmp_path / "in"))
    validate(read_text(spark, str(tmp_path / "in")), labels, KEY).explain()
    assert capsys.readouterr().out.count("FileScan") == 1


def test_rejects_keep_bad_text(applicant, model):
    odd = applicant.withColumns({"person_income": F.lit("12d"), "person_emp_length": F.lit("long")})
    scored, rejects = score(model, odd)
    row = rejects.first()
    assert scored.count() == 0 and (row["person_income"], row["person_emp_length"]) == ("12d", "long")
    assert set(row["reasons"]) == {"type_incompatible:person_income", "type_incompatible:person_emp_length"}


def test_confusion_is_square_and_whole(spark):
    rows = spark.createDataFrame([(0, 0), (0, None), (1, 7), (None, 1)], "y int, p int")
    cells = {r["truth"]: tuple(r)[1:] for r in confusion(rows, "y", "p", [0, 1, 2]).collect()}
    assert cells == {0: (1, 0, 0, 1), 1: (0, 0, 0, 1), 2: (0, 0, 0, 0), None: (0, 1, 0, 0)}
