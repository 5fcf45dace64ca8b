"""Plans: stage wiring (which operator feeds which), the query registry and
the DuckDB oracle SQL used by the correctness gate."""
