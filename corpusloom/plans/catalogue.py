"""All queries over the driver's tables and the SQL that must give the same rows."""

from __future__ import annotations

from . import corpus, labels, market, study

QUERIES: dict = corpus.QUERIES | labels.QUERIES | market.QUERIES | study.QUERIES
SQL: dict = corpus.SQL | labels.SQL | market.SQL | study.SQL
