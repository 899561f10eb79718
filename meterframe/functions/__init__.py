"""Column-level building blocks: aggregations, metadata paths, predicates, time."""
