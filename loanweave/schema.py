"""The loan-application table: column roles, declared types and fixed domains."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "application_id"
LABEL = "loan_status"

NUMERIC = (
    "person_age",
    "person_income",
    "person_emp_length",
    "loan_amnt",
    "loan_int_rate",
    "loan_percent_income",
    "cb_person_cred_hist_length",
)
CATEGORICAL = ("person_home_ownership", "loan_intent", "cb_person_default_on_file")

# The columns a scoring input must carry, in contract order.
CONTRACT = (
    "person_age",
    "person_income",
    "person_home_ownership",
    "person_emp_length",
    "loan_intent",
    "loan_amnt",
    "loan_int_rate",
    "loan_percent_income",
    "cb_person_default_on_file",
    "cb_person_cred_hist_length",
)

# Missing values of these are filled by the fitted median; in any other model input they make a row unscorable.
IMPUTED = ("person_emp_length", "loan_int_rate")
# Required from a caller and profiled, but not fed to the model.
NOT_A_FEATURE = ("loan_percent_income",)

APPLICATION_SCHEMA = T.StructType(
    [
        T.StructField(KEY, T.LongType()),
        T.StructField("person_age", T.IntegerType()),
        T.StructField("person_income", T.DoubleType()),
        T.StructField("person_home_ownership", T.StringType()),
        T.StructField("person_emp_length", T.DoubleType()),
        T.StructField("loan_intent", T.StringType()),
        T.StructField("loan_amnt", T.DoubleType()),
        T.StructField("loan_int_rate", T.DoubleType()),
        T.StructField("loan_percent_income", T.DoubleType()),
        T.StructField("cb_person_default_on_file", T.StringType()),
        T.StructField("cb_person_cred_hist_length", T.IntegerType()),
        T.StructField(LABEL, T.IntegerType()),
    ]
)
COLUMNS = tuple(APPLICATION_SCHEMA.fieldNames())
