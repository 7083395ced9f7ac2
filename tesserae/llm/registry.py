"""The queries of the training-data operators, one for each, and their SQL."""

from __future__ import annotations

from tesserae.llm import queries as q


def queries() -> dict:
    return dict(q.QUERIES)


def oracle_sql() -> dict:
    return dict(q.ORACLES)
