"""Constrained low-rank analytics on Spark."""
