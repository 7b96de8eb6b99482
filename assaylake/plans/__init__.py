"""Queries over the driver tables."""

from . import catalog, cleanup, criteria, documents, layout, pairs, recovery, repair, rules, scoring, sequences, text
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalog", "cleanup", "criteria", "documents", "layout", "pairs", "recovery", "repair", "rules", "scoring", "sequences", "text"]
