"""Queries over one store."""
