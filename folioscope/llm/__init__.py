"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame with at least
the columns it names (extra columns are ignored unless stated), treats a null text as empty
unless its docstring says otherwise, and returns one row per input row where it describes rows.
"""
