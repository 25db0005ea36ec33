"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage.  Each operator module
offers a general function on DataFrames; ``queries`` registers the thin
``opN_<name>`` queries on top of them.
"""
