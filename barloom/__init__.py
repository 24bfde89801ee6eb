"""Ordered-series analytics on Spark: bars in, indicator series, signals and reports out."""
