"""Registered queries; importing the package fills the registry."""

from graphloom.queries import graph, indexes, ordered, served, statistics, stored_queries, streams, tables, text_queries, texts  # noqa: F401
from graphloom.queries.registry import ORACLE, QUERIES  # noqa: F401
