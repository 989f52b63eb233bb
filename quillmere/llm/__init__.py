"""Operators that prepare training data for language models.

Nothing else in the library imports this subpackage; ``registry`` lists its
queries for the entry file.
"""
