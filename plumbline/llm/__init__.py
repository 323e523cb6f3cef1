"""Operators of a training-data pipeline: near duplicates, scoring, tokens, search and mixing.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
