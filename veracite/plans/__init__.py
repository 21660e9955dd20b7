"""Registered queries and the SQL that they are held against."""

from .oracle import ORACLE
from .queries import QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
