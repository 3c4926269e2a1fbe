"""feedweave: Spark jobs for content feeds (ingest, merge, rank, search, extract, check)."""
