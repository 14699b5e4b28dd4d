"""DataFrame operators: columns, grouping, windows, ranking."""
