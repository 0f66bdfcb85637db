"""Incremental ingest of a snapshot folder."""
