"""Whole jobs: configuration and the pipeline from documents to output."""
