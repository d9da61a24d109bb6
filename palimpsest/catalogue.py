"""All queries this library registers, with the SQL each is checked against."""

from __future__ import annotations

from palimpsest.queries import files, questions, relational, texts, vectors, versions
from palimpsest.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "files", "questions", "relational", "texts", "vectors", "versions"]
