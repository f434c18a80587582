"""All queries of the core by name, and the SQL they are held against."""

from __future__ import annotations

from genoplane.plans import evaluation_queries, genome_queries, reference_checks

QUERIES = genome_queries.QUERIES | evaluation_queries.QUERIES | reference_checks.QUERIES
SQL = genome_queries.SQL | evaluation_queries.SQL | reference_checks.SQL
FLAGSHIP = "w1_gap_clusters"
