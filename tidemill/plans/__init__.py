"""Queries over the star schema and the events."""
