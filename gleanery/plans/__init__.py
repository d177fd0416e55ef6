"""Composed pipelines and the query catalog."""
