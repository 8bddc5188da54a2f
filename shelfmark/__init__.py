"""Spark jobs over a catalog of datasets: ingest, search, resolve, evaluate."""
