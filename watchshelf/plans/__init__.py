"""Whole reads: catalog, collections, dashboard, activity, ingestion."""
