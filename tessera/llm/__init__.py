"""Operators for training-data pipelines.

Nothing outside this subpackage imports it.  ``registry`` holds the queries
and their SQL; every other module holds one operator.
"""
