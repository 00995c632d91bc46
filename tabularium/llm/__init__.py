"""Operators for building training data: search, near-duplicates, scans, mixing, tokens and their output.

One module per operator, ``queries`` applies them to whole tables, ``storage`` and ``components`` are shared.
"""
