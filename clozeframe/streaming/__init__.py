"""No operator of this library has a time column, watermark or unbounded state, so nothing is built here.

The row-local column functions in ``clozeframe.functions`` also work on streaming DataFrames.
"""
