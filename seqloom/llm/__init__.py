"""Operators for large text corpora: scoring, matching, formatting, mixing.

Nothing outside this folder imports it, so it can be removed as a whole.
"""
