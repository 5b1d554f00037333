"""Functions of the line-table engine."""
