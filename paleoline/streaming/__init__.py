"""Streaming of the line-table engine."""
