"""Registered graph queries and their SQL twins. Names and columns match between the two."""

from loomgraph.sources import tpch_graph as src

QUERIES, SQL = {}, {}
GRAPH = f"WITH {src.SQL} "


def query(sql: str | None = None, prefix: str = GRAPH, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = prefix + sql
        return f

    return add
