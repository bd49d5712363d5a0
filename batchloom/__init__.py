"""Batch analysis on Spark: ingest, enrich, roll up, query and export work items."""
