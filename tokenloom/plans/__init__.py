"""Composed pipelines and the query bindings."""
