"""Operators that prepare text corpora for training, each a Spark job.

Nothing outside this subpackage imports it.
"""
