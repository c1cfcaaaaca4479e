"""Weftline: cohort analytics over ordered records, expressed as Spark DataFrames."""
