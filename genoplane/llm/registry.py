"""The subpackage's queries by name, and the SQL they are held against."""

from __future__ import annotations

from genoplane.llm.queries import QUERIES
from genoplane.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]
