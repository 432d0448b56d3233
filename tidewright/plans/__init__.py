"""Plans: bars from transaction tables, and the stages chained from settings."""
