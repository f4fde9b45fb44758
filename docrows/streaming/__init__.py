"""Incremental ingest of folders, and jobs."""
