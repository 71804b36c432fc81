"""Operators for training-data corpora: quality, dedup, mixing, tokenising and media.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; the registered queries are in ``handbill.llm.queries``.
"""
