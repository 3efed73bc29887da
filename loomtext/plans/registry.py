"""All queries outside the training-data subpackage, by name."""

from __future__ import annotations

from . import catalogue, learning, lm, search, streams, text  # noqa: F401  register their queries
from ._register import ORACLE_SQL, QUERIES

FLAGSHIP = "bm25_top10"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
