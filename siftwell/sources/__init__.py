"""Stored design matrices."""
