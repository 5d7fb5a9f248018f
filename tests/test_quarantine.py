"""Lines that are no rows are set aside, with file and reason; all others are read."""

import pytest

from loanweave.sources.quarantine import OPEN_QUOTE, TOO_FEW, TOO_MANY, quarantine, read_checked

HEADER = "application_id,person_income,loan_intent,loan_amnt"


def put(tmp_path, name, *lines):
    (tmp_path / name).write_text("\n".join([HEADER, *lines]) + "\n")


def test_good_and_rejects_are_all_lines(spark, tmp_path):
    put(
        tmp_path, "a.csv", "1,100,MEDICAL,5", "2,200", "3,300,VENTURE,7,extra,more", '4,400,"MEDICAL,8', '5,500,"a, ""b"", c",9', "",
        '6,600,MEDICAL,"7', "7,NA,,",
    )
    put(tmp_path, "b.csv", "8,800,VENTURE,1", "9", HEADER)
    found = quarantine(spark, str(tmp_path))
    good = {r["application_id"]: r for r in found.good.collect()}
    assert set(good) == {"1", "5", "7", "8", "application_id"}  # a header that is repeated is a row of text, as in a plain read
    assert good["5"]["loan_intent"] == 'a, "b", c'
    assert good["7"]["person_income"] is None and good["7"]["loan_intent"] is None
    rejects = {r["line"]: (r["file"].rsplit("/", 1)[1], r["n_fields"], r["reason"]) for r in found.rejects.collect()}
    assert rejects == {
        "2,200": ("a.csv", 2, TOO_FEW),
        "3,300,VENTURE,7,extra,more": ("a.csv", 6, TOO_MANY),
        '4,400,"MEDICAL,8': ("a.csv", 4, OPEN_QUOTE),
        '6,600,MEDICAL,"7': ("a.csv", 4, OPEN_QUOTE),
        "9": ("b.csv", 1, TOO_FEW),
    }
    assert found.lines.count() == len(good) + len(rejects)


def test_applications_from_a_broken_file(spark, tmp_path):
    put(tmp_path, "a.csv", "1,100.5,MEDICAL,5", "2,abc,VENTURE,6", "3,1", "4,NA,,7e2")
    loans, broken = read_checked(spark, str(tmp_path))
    assert sorted(tuple(r) for r in loans.collect()) == [(1, 100.5, "MEDICAL", 5.0), (2, None, "VENTURE", 6.0), (4, None, None, 700.0)]
    assert dict(loans.dtypes) == {"application_id": "bigint", "person_income": "double", "loan_intent": "string", "loan_amnt": "double"}
    assert [r["line"] for r in broken.collect()] == ["3,1"]


def test_other_separator(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a;b\n1;2\n1;2;3\n"x;y";2\n')
    found = quarantine(spark, str(tmp_path), sep=";")
    assert sorted(tuple(r) for r in found.good.collect()) == [("1", "2"), ("x;y", "2")]
    assert [r["reason"] for r in found.rejects.collect()] == [TOO_MANY]


def test_long_and_quoted_lines(spark, tmp_path):
    text = 'x""y,' * 20_000
    put(tmp_path, "a.csv", f'1,2,"{text}",3')
    found = quarantine(spark, str(tmp_path))
    assert found.rejects.isEmpty()
    assert found.good.first()["loan_intent"] == 'x"y,' * 20_000


def test_header_only_and_missing_file(spark, tmp_path):
    put(tmp_path, "a.csv")
    found = quarantine(spark, str(tmp_path))
    assert found.good.isEmpty() and found.rejects.isEmpty() and found.good.columns == HEADER.split(",")
    with pytest.raises(FileNotFoundError):
        quarantine(spark, str(tmp_path / "none"))


def test_a_file_with_another_header_stops_the_job(spark, tmp_path):
    put(tmp_path, "a.csv", "1,2,3,4")
    (tmp_path / "b.csv").write_text("application_id,loan_amnt,loan_intent,person_income\n1,2,3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        quarantine(spark, str(tmp_path)).good.collect()
