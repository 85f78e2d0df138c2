"""Queries and experiments put together from operators."""
