"""Queries by name, and the SQL that each should equal."""

from . import aligned, assembled, lanes, passages, small, timeline, translated


def queries() -> dict:
    return passages.QUERIES | timeline.QUERIES | small.QUERIES | assembled.QUERIES | lanes.QUERIES | translated.QUERIES | aligned.QUERIES


def oracle_sql() -> dict:
    return passages.SQL | timeline.SQL | small.SQL | assembled.SQL | lanes.SQL | translated.SQL | aligned.SQL
