"""Pipelines from raw rows to a backbone."""
