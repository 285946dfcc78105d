"""Training-data operators. Nothing else in the library imports this subpackage.

Operators take a DataFrame, read the columns they are told to read and nothing else, and return columns of
their own, so further columns of the input never clash with theirs.
"""
