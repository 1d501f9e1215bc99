"""Composed plans: the engine, the query registry and its SQL."""
