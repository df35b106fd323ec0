"""Verification of record pairs, and the pipelines around it, on Spark DataFrames."""
