"""Query catalog: Spark plans and their SQL oracles."""

from campusledger.plans.catalog import ORACLE, QUERIES, load_all

__all__ = ["ORACLE", "QUERIES", "load_all"]
