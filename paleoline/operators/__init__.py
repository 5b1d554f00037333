"""Operators of the line-table engine."""
