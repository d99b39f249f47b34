"""Operators for preparing language-model training data, each one a Spark job.

Nothing else in the library imports this subpackage.
"""
