"""Operators for large training corpora.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns DataFrames; ``registry`` binds the ``opN_*`` queries and their SQL.
"""
