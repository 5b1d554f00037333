"""Plans of the line-table engine."""
