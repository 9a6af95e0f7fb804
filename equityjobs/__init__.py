"""Equity-research data jobs on Spark DataFrames."""
