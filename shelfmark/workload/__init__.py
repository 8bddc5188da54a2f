"""Every operator as a query over the driver's tables, with SQL that gives the same rows."""

from importlib import import_module

from shelfmark.workload.registry import ORACLE, QUERIES

for _part in ("search", "dense", "health", "ingest", "samples", "evaluation", "storage"):
    import_module(f"shelfmark.workload.{_part}")


def all_queries():
    return dict(QUERIES)


def all_sql():
    return dict(ORACLE)
