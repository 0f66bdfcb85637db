"""Operators over the archive tables."""
