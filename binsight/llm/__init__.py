"""Operators for the preparation of language-model training data.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and column names and returns DataFrames; ``catalog.py`` registers
one thin query per operator.
"""
