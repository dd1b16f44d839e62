"""Operators for preparing training text, each a function over DataFrames.

Nothing outside this subpackage imports it.  `queries` registers one query per
operator; `corpus_pipeline` at the repository top chains five of them.
"""
