"""Spark-first engine for gridded observations and station time series."""
