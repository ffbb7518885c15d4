"""Named plans over the driver tables: fixtures (views built from the given
tables), the registered queries, and their DuckDB oracle SQL."""
