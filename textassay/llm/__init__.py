"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it.  Each module holds one operator with
a general DataFrame interface and states its behaviour on nulls, ties, repeated
rows, empty tables and clashing column names; ``entries`` holds the thin
``opN_*`` queries and their SQL.
"""
