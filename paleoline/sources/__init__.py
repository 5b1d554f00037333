"""Sources of the line-table engine."""
