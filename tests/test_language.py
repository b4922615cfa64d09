"""The query language on small graphs: parsing, errors, paging, and meanings that are easy to get wrong."""

import pytest

from loomgraph.lang.cypher import QueryError, cypher, cypher_page, parse
from loomgraph.model import EDGES, NODES, Graph, complete


def graph(spark, nodes, edges=()):
    n = spark.createDataFrame([(i, "p", label, name, i, "a.ts", line, line, props) for i, label, name, line, props in nodes], NODES)
    e = spark.createDataFrame([(*x, "p", "{}", 1.0) for x in edges], "source_id string, target_id string, type string, project string, props string, confidence double")
    return Graph(n, complete(e, EDGES))


@pytest.fixture(scope="module")
def small(spark):
    nodes = [("a", "Function", "init", 1, "{}"), ("b", "Function", "render", 12, '{"kind": "render"}'), ("c", "Function", "Helper", 50, '{"kind": "life", "n": 7, "on": true}'), ("w", "Class", "Widget", 1, "{}")]
    return graph(spark, nodes, [("a", "b", "CALLS"), ("b", "c", "ASYNC_CALLS"), ("c", "a", "CALLS"), ("w", "b", "DEFINES")])


def found(g, text):
    return sorted(tuple(r) for r in cypher(g, text).collect())


def test_meanings(small):
    assert found(small, "MATCH (n) WHERE n.name CONTAINS 'HELP' RETURN n.id") == [("c",)]
    assert found(small, "MATCH (n) WHERE n.label = 'Class' AND n.name = 'x' OR n.name = 'Widget' RETURN n.id") == [("w",)]
    assert found(small, "MATCH (n) WHERE n.start_line = '12' RETURN n.id") == [("b",)]
    assert found(small, "MATCH (n) WHERE n.n = 7 AND n.on = 1 RETURN n.id, n.kind AS k") == [("c", "life")]
    assert found(small, "MATCH (n) WHERE n.name IN [] RETURN n.id") == []
    assert found(small, "MATCH (n:Function) WHERE NOT ()-[:CALLS|ASYNC_CALLS]->(n) RETURN n.id") == []
    assert found(small, "MATCH (n:Function) WHERE NOT ()-[:CALLS]->(n) RETURN n.id") == [("c",)]
    assert found(small, "MATCH (x)-[:CALLS*1..3]->(y) RETURN x.id, y.id") == [("a", "b"), ("c", "a"), ("c", "b")]
    assert found(small, "MATCH (n) WHERE n.name <> 'SET it' RETURN COUNT(n)") == [(4,)]
    assert found(small, "MATCH (a)-[:CALLS]->(b), (b)-[:ASYNC_CALLS]->(c) RETURN a.id, c.id") == [("a", "c")]
    assert found(small, "MATCH (a:Class) OPTIONAL MATCH (a)-[:CALLS]->(b) RETURN a.id, b.id") == [("w", None)]
    assert found(small, "MATCH (n:Class) RETURN labels(n) AS x") == [("Class",)]
    assert cypher(small, "MATCH (n:Class) RETURN labels(n) AS x").columns == ["labels_n"]


@pytest.mark.parametrize("text", [
    "", "MATCH (n)", "RETURN n.id", "CREATE (n) RETURN n", "MATCH (n) SET n.x = 1 RETURN n", "MATCH (a)-[:X]->(b)-[:Y]->(c) RETURN a.id", "MATCH (a)-[*1..3]->(b) RETURN a.id", "MATCH (n) WHERE n.x LIKE 'a' RETURN n.id",
    "MATCH (n) RETURN size(n)", "MATCH (a), (b) RETURN a.id", "MATCH (n) RETURN n.label, COUNT(n)", "MATCH (n) RETURN m.id",
])
def test_errors(small, text):
    with pytest.raises(QueryError):
        cypher(small, text)


def test_literals():
    q = parse("MATCH (n) WHERE n.a = 5abc AND n.b = word AND n.c = \"it's\" AND n.indexed_at > '2020-01-01' RETURN n")
    assert [g[0].value for g in q.where] == [5, "word", "it's", 1577836800000]


def test_paging(spark):
    g = graph(spark, [(f"fn{i:03}", "Function", f"fn{i:03}", 1, "{}") for i in range(250)])
    text = "MATCH (n) RETURN n.id ORDER BY n.id"
    first = cypher_page(g, text)
    assert (first.total, first.truncated, first.rows[-1]) == (200, True, ("fn199",))
    last = cypher_page(g, text, limit=100, offset=200)
    assert (last.total, last.truncated) == (50, False)
    assert cypher_page(g, text + " LIMIT 3").rows == [("fn000",), ("fn001",), ("fn002",)]
