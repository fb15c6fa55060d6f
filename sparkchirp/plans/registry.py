"""All named queries of the engine and their SQL."""

from . import catalogue, file_queries, search_queries

QUERIES = catalogue.QUERIES | file_queries.QUERIES | search_queries.QUERIES
SQL = catalogue.SQL | file_queries.SQL | search_queries.SQL
