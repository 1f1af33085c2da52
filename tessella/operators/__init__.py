"""Relational and row-local operators."""
