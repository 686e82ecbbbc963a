"""Training-data operators: text, page and URL tables in, DataFrames out.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface plus the thin ``opN_*`` query over it.
"""
