"""Solicitation data engine: ingest, linkage, reference resolution, curation and reports as Spark jobs."""
