"""Registered queries of the grid operators and their SQL."""

from latticeql.plans import depth_queries, grid_queries, level_queries, more_queries, run_queries


def queries() -> dict:
    return grid_queries.QUERIES | more_queries.QUERIES | level_queries.QUERIES | depth_queries.QUERIES | run_queries.QUERIES


def oracle_sql() -> dict:
    return grid_queries.SQL | more_queries.SQL | level_queries.SQL | depth_queries.SQL | run_queries.SQL
