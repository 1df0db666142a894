"""Operators for building language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; :mod:`fathomgrid.llm.registry` holds the thin ``opN_*`` queries over the driver tables.
"""
