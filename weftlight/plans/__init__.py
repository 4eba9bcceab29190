"""Plan helpers (sized joins, lineage) and the catalogue of queries."""
