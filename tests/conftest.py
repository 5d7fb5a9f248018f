from __future__ import annotations

import pytest

from loanweave.plans.model_queries import forest_model
from loanweave.schema import CONTRACT
from loanweave.session import local_session
from loanweave.sources import credit, from_rows

SF = "/root/testdata/sf0.001"

# One applicant with every field in the usual range.
APPLICANT = (41, 52300.0, "RENT", 9.0, "MEDICAL", 7400.0, 9.25, 0.14, "N", 12)
APPLICANT_COLUMNS = list(CONTRACT)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", app="loanweave-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def loans(spark):
    df = credit(spark, SF).cache()
    df.count()
    return df


@pytest.fixture(scope="session")
def model(spark):
    return forest_model(spark, SF)


@pytest.fixture
def applicant(spark):
    return from_rows(spark, [APPLICANT], APPLICANT_COLUMNS)
