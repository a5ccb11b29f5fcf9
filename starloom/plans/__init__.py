"""Registered catalogue queries and their SQL."""

from starloom.plans.registry import catalogue_queries, catalogue_sql, flagship

__all__ = ["catalogue_queries", "catalogue_sql", "flagship"]
