"""Operators of a training-data pipeline: mixing, deduplication, decontamination, scoring, media, urls, token counts.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered queries and ``sql.py`` their SQL.
"""
