"""Grading and routing-evaluation operators for PySpark DataFrames."""
