"""All queries of the library outside the llm subpackage, with their oracle SQL."""

from __future__ import annotations

from glossa.plans import evaluation, files, ingest, kpi, learning, lexical, lists, qa, reports, store, streams, transactions
from glossa.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "evaluation", "files", "ingest", "kpi", "learning", "lexical", "lists", "qa", "reports", "store", "streams", "transactions"]
