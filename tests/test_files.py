from types import SimpleNamespace

import pytest

from loanweave.operators import check_columns
from loanweave.schema import APPLICATION_SCHEMA, CONTRACT
from loanweave.session import scratch_path
from loanweave.sources import export_csv, from_rows, load_portfolio, normalise, read_applications, read_text

from .conftest import APPLICANT_COLUMNS

HEADER = "loan_amnt,person_age,person_income,person_home_ownership,person_emp_length,loan_status,extra"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_columns_are_matched_by_name(spark, tmp_path):
    path = write(tmp_path / "a.csv", f"{HEADER}\n500,35,1e4,RENT, 5 ,1,x\nbad,40,NA,, NaN,0,\n")
    df = read_applications(spark, path, name="applications")
    assert dict(df.dtypes)["person_age"] == "int" and dict(df.dtypes)["loan_amnt"] == "double"
    first, second = df.orderBy("person_age").collect()
    assert (first["loan_amnt"], first["person_income"], first["person_emp_length"]) == (500.0, 10000.0, 5.0)
    assert second["loan_amnt"] is None and second["person_income"] is None
    assert second["person_home_ownership"] is None and second["person_emp_length"] is None
    assert spark.table("applications").count() == 2


def test_large_keys_survive(spark, tmp_path):
    key = 2**60 + 1
    path = write(tmp_path / "a.csv", f"application_id,person_age\n{key},30\n")
    assert read_applications(spark, path).first()["application_id"] == key


def test_inferred_types_and_other_delimiter(spark, tmp_path):
    path = write(tmp_path / "a.csv", "person_age;note\n30;x\n31;y\n")
    df = read_applications(spark, path, sep=";", infer=True)
    assert df.dtypes == [("person_age", "int"), ("note", "string")]


def test_missing_file_says_so(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nowhere.csv"):
        read_applications(spark, str(tmp_path / "nowhere.csv"))


def test_header_only_and_wrong_delimiter(spark, tmp_path):
    path = write(tmp_path / "a.csv", HEADER + "\n")
    assert read_applications(spark, path).count() == 0
    assert set(check_columns(read_text(spark, path, sep=";").columns).missing) == set(CONTRACT)


def test_portfolio_has_no_outliers(spark, tmp_path):
    path = write(tmp_path / "a.csv", f"{HEADER}\n500,35,1,RENT,5,1,x\n500,135,1,RENT,5,1,x\n500,35,1,RENT,,1,x\n")
    assert load_portfolio(spark, path).count() == 1


def test_local_rows_get_the_declared_types(applicant):
    assert applicant.schema.fieldNames() == APPLICANT_COLUMNS
    assert all(applicant.schema[c].dataType == APPLICATION_SCHEMA[c].dataType for c in APPLICANT_COLUMNS)


def test_local_rows_of_the_wrong_type_are_refused(spark):
    with pytest.raises(Exception, match="person_age"):
        from_rows(spark, [("old",)], ["person_age"])


def test_normalise(spark):
    df = spark.createDataFrame([(float("nan"), " ")], "person_income double, loan_intent string")
    assert tuple(normalise(df).first()) == (None, None)


def test_export_has_a_header_and_keeps_existing_data(spark, tmp_path):
    df = spark.range(3)
    path = export_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(path).columns == ["id"]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        export_csv(df, path)


def session_stub(master: str, **conf: str):
    context = SimpleNamespace(master=master, getConf=lambda: conf)
    return SimpleNamespace(sparkContext=context)


def test_scratch_is_the_cluster_folder_where_one_is_named(spark):
    cluster = session_stub("yarn", **{"spark.checkpoint.dir": "/shared/folder/"})
    assert scratch_path(cluster, "x").startswith("/shared/folder/loanweave-x-")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_no_machine_local_scratch_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(session_stub("yarn"), "x")


def test_quotes_and_line_breaks_survive_export(spark, tmp_path):
    rows = [('a "b", c', 1), ("two\nlines", 2), ("plain", 3)]
    path = export_csv(spark.createDataFrame(rows, "note string, n int"), str(tmp_path / "out"))
    back = read_text(spark, path, multiline=True).collect()
    assert sorted((r["note"], int(r["n"])) for r in back) == sorted(rows)


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.csv", "person_age,person_income\n30,1000\n")
    write(tmp_path / "in" / "b.csv", "person_income,person_age\n2000,40\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_text(spark, str(tmp_path / "in")).collect()


def test_markers_are_missing_before_validation(spark, tmp_path):
    path = write(tmp_path / "a.csv", "person_age,person_emp_length\n30,NA\n")
    assert read_text(spark, path).first()["person_emp_length"] is None


def test_inference_leaves_missing_markers_out(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b,c,d\n1,NA,3000000000,x\nNA,2.5,1,7\n")
    df = read_applications(spark, path, infer=True)
    assert df.dtypes == [("a", "int"), ("b", "double"), ("c", "bigint"), ("d", "string")]
    assert [tuple(r) for r in df.collect()] == [(1, None, 3000000000, "x"), (None, 2.5, 1, "7")]


def test_a_fraction_is_no_whole_number(spark, tmp_path):
    path = write(tmp_path / "a.csv", "application_id,person_age\n1,35.7\n2,35.0\n")
    assert [r["person_age"] for r in read_applications(spark, path).collect()] == [None, 35]
