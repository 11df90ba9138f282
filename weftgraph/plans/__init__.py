"""Plans: lineage control, the query catalogue and experiment configurations."""
