"""Operators for large-scale training-data preparation.

Nothing outside this package imports it. Every operator takes DataFrames and
column names, keeps to the columns it needs and returns a DataFrame.
"""
