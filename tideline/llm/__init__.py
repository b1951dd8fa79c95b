"""Operators for preparing language-model training data.

Nothing else in the library imports this package. Operators take DataFrames and return
DataFrames; `queries` holds the registered queries over the given tables.
"""
