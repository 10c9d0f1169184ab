"""Measures of retrieval and reports of runs, as DataFrames."""
