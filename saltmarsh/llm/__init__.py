"""Operators that prepare text for training language models, each one a Spark job.

Nothing else in the library imports this subpackage.
"""
