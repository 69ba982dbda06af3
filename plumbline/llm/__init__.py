"""Operators of a training-data pipeline: ten building blocks over text corpora.

Nothing else in the library imports this subpackage; it can be deleted on its own.
"""
