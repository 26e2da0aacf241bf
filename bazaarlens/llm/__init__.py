"""Operators that prepare a text corpus for training language models.

Nothing else in the library imports this subpackage. Every operator takes DataFrames and returns
DataFrames; only the columns it names are read, so further columns of the input never clash with
its results.
"""
