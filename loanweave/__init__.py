"""Loan-portfolio analytics and default-risk scoring on Spark DataFrames."""
