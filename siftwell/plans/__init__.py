"""Selectors: driver programs over Spark jobs."""
