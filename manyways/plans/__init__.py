"""All queries over the driver's tables, by name."""

from manyways.plans import ablation_sql, arbitration_sql, checks_sql, documents_sql, forks_sql, lineage_sql, members_sql, projections_sql, rationale_sql, review_sql, sheets_sql, structure_sql

QUERIES = {**forks_sql.QUERIES, **structure_sql.QUERIES, **documents_sql.QUERIES, **members_sql.QUERIES, **ablation_sql.QUERIES, **projections_sql.QUERIES, **review_sql.QUERIES, **checks_sql.QUERIES, **lineage_sql.QUERIES, **rationale_sql.QUERIES, **sheets_sql.QUERIES, **arbitration_sql.QUERIES}
