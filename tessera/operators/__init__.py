"""Table-level operators: joins, aggregates, windows, sets, linkage, statistics."""
