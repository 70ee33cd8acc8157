"""Jobs and registered driver queries: bindings over the driver tables, the
minimal slice, the whole pipeline and the query modules with their DuckDB
oracles."""
