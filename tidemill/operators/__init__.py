"""Relational building blocks beyond single DataFrame calls."""
