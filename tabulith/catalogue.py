"""All queries of the table engine, with the SQL that states the same result."""

from __future__ import annotations

from tabulith.queries import pages, statement, tables, values  # noqa: F401
from tabulith.queries.base import ORACLE_SQL, QUERIES  # noqa: F401


def FLAGSHIP(spark, sf_dir):
    return QUERIES["statement_roundtrip"](spark, sf_dir)
