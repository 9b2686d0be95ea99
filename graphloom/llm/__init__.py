"""Operators for large training-data corpora.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the Python kernels work on Arrow batches cut into bounded chunks.
"""
