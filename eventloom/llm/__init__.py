"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames, reads only the columns it names, and so never meets extra
columns of its input; functions that keep the input's other columns say so.
"""
