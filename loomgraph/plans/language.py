"""Queries that are compiled from text. Their twins state the rule in SQL of their own."""

from loomgraph.lang.cypher import cypher
from loomgraph.plans.registry import GRAPH, query
from loomgraph.sources import tpch_graph as src

# name -> (query text, SQL twin)
TEXTS = {
    "single_label_filter": ("MATCH (n:Nation) RETURN n.id, n.name", "SELECT id AS n_id, name AS n_name FROM nodes WHERE label = 'Nation'"),
    "any_node": ("MATCH () RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM nodes"),
    "whole_node": ("MATCH (n:Region) RETURN n", "SELECT id AS n FROM nodes WHERE label = 'Region'"),
    "labels_of": ("MATCH (n:Supplier) RETURN n.name, labels(n)", "SELECT name AS n_name, label AS labels_n FROM nodes WHERE label = 'Supplier'"),
    "prop_json_filter": ("MATCH (n:Part) WHERE n.kind = 'PROMO' AND n.price > 901 RETURN n.id, n.kind AS kind", "SELECT id AS n_id, kind FROM nodes WHERE kind = 'PROMO' AND price > 901"),
    "prop_json_true": ("MATCH (n:Part) WHERE n.is_entry_point = 1 RETURN n.id", "SELECT id AS n_id FROM nodes WHERE entry"),
    "contains_ilike": ("MATCH (n:Part) WHERE n.name CONTAINS 'WIDG' RETURN n.id, n.name", "SELECT id AS n_id, name AS n_name FROM nodes WHERE label = 'Part' AND lower(name) LIKE '%widg%'"),
    "contains_wildcard": ("MATCH (n:Part) WHERE n.name CONTAINS 'r%_t' RETURN n.id", "SELECT id AS n_id FROM nodes WHERE label = 'Part' AND lower(name) LIKE '%r%_t%'"),
    "starts_with": ("MATCH (n) WHERE n.name STARTS WITH 'customer#00' RETURN n.id", "SELECT id AS n_id FROM nodes WHERE lower(name) LIKE 'customer#00%'"),
    "ends_with": ("MATCH (n:Part) WHERE n.name ENDS WITH 'GEAR' RETURN n.id, n.name", "SELECT id AS n_id, name AS n_name FROM nodes WHERE label = 'Part' AND lower(name) LIKE '%gear'"),
    "in_list": ("MATCH (n) WHERE n.name IN ['red widget', 'EUROPE', 'hot gear'] RETURN n.id", "SELECT id AS n_id FROM nodes WHERE name IN ('red widget', 'EUROPE', 'hot gear')"),
    "in_numbers": ("MATCH (n) WHERE n.start_line IN [1, 2, 50] RETURN n.id", "SELECT id AS n_id FROM nodes WHERE start_line IN (1, 2, 50)"),
    "labels_in": ("MATCH (n) WHERE labels(n) IN ['Region', 'Supplier'] RETURN n.id", "SELECT id AS n_id FROM nodes WHERE label IN ('Region', 'Supplier')"),
    "or_precedence": ("MATCH (n) WHERE n.label = 'Part' AND n.start_line > 40 OR n.name STARTS WITH 'red' RETURN n.id", "SELECT id AS n_id FROM nodes WHERE label = 'Part' AND (start_line > 40 OR lower(name) LIKE 'red%')"),
    "or_chain": ("MATCH (n:Part) WHERE n.start_line = 1 OR n.start_line = 2 AND n.kind = 'SMALL' OR n.kind = 'LARGE' RETURN n.id", "SELECT id AS n_id FROM nodes WHERE (start_line = 1 OR start_line = 2) AND (kind = 'SMALL' OR kind = 'LARGE')"),
    "not_equal_drops_null": ("MATCH (n) WHERE n.file_path <> 'Brand#1' RETURN n.id", "SELECT id AS n_id FROM nodes WHERE file_path <> 'Brand#1'"),
    "null_check": ("MATCH (n) WHERE n.file_path IS NULL AND n.label <> 'Customer' RETURN n.id, n.name", "SELECT id AS n_id, name AS n_name FROM nodes WHERE file_path IS NULL AND label <> 'Customer'"),
    "numeric_range": ("MATCH (n) WHERE n.startLine >= 10 AND n.startLine < 20 RETURN n.id, n.endLine", "SELECT id AS n_id, end_line AS n_endLine FROM nodes WHERE start_line >= 10 AND start_line < 20"),
    "hop_out": ("MATCH (a:Part)-[r:CALLS]->(b:Part) RETURN a.id, a.name, b.id, r.type, r.confidence", "SELECT a.id AS a_id, a.name AS a_name, b.id AS b_id, type AS r_type, confidence AS r_confidence FROM edges e JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id WHERE type = 'CALLS' AND a.label = 'Part' AND b.label = 'Part'"),
    "hop_in": ("MATCH (a:Part)<-[:ASYNC_CALLS]-(b) RETURN a.id, b.name AS caller", "SELECT a.id AS a_id, b.name AS caller FROM edges JOIN nodes a ON a.id = target_id JOIN nodes b ON b.id = source_id WHERE type = 'ASYNC_CALLS' AND a.label = 'Part'"),
    "hop_any_type": ("MATCH (a:Nation)-[r]->(b) RETURN a.name, r.type, b.name", "SELECT a.name AS a_name, type AS r_type, b.name AS b_name FROM edges JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id WHERE a.label = 'Nation'"),
    "hop_edge_prop": ("MATCH (a)-[r:CALLS]->(b) WHERE r.confidence >= 0.99 RETURN a.id, b.id", "SELECT source_id AS a_id, target_id AS b_id FROM edges WHERE type = 'CALLS' AND confidence >= 0.99"),
    "multi_hop_chain": ("MATCH (r:Region)-[:CONTAINS_FOLDER]->(n), (n)-[:CONTAINS_FILE]->(c:Customer) RETURN r.name, n.name, c.id", "SELECT r.name AS r_name, n.name AS n_name, c.id AS c_id FROM edges x JOIN edges y ON x.target_id = y.source_id JOIN nodes r ON r.id = x.source_id JOIN nodes n ON n.id = x.target_id JOIN nodes c ON c.id = y.target_id WHERE x.type = 'CONTAINS_FOLDER' AND y.type = 'CONTAINS_FILE'"),
    "multi_hop_cycle": ("MATCH (a:Part)-[:CALLS]->(b), (b)-[:CALLS]->(a) RETURN a.id, b.id", "SELECT x.source_id AS a_id, x.target_id AS b_id FROM edges x JOIN edges y ON x.target_id = y.source_id AND x.source_id = y.target_id WHERE x.type = 'CALLS' AND y.type = 'CALLS'"),
    "optional_match": ("MATCH (n:Part) OPTIONAL MATCH (n)-[:CALLS]->(m) RETURN n.id, m.name", "SELECT n.id AS n_id, m.name AS m_name FROM nodes n LEFT JOIN (SELECT source_id, b.name FROM edges JOIN nodes b ON b.id = target_id WHERE type = 'CALLS') m ON n.id = m.source_id WHERE n.label = 'Part'"),
    "unwind_list": ("UNWIND ['red widget', 'hot gear', 'red widget'] AS name MATCH (n) RETURN n.id, name", "SELECT id AS n_id, v AS name FROM nodes JOIN (SELECT unnest(['red widget', 'hot gear', 'red widget']) AS v) ON name = v"),
    "not_exists_in": ("MATCH (n) WHERE NOT ()-[:CALLS]->(n) RETURN n.id", "SELECT id AS n_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_id = n.id AND type = 'CALLS')"),
    "not_exists_out": ("MATCH (n) WHERE NOT (n)-[:HTTP_CALLS]->() AND n.label <> 'Customer' RETURN n.id", "SELECT id AS n_id FROM nodes n WHERE label <> 'Customer' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.source_id = n.id AND type = 'HTTP_CALLS')"),
    "not_exists_any": ("MATCH (n) WHERE NOT (n)<--() RETURN n.id", "SELECT id AS n_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_id = n.id)"),
    "not_exists_alternation": ("MATCH (n) WHERE NOT ()-[:CALLS|ASYNC_CALLS]->(n) RETURN n.id", "SELECT id AS n_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_id = n.id AND type IN ('CALLS', 'ASYNC_CALLS'))"),
    "not_exists_or": ("MATCH (n:Nation) WHERE NOT (n)-[:CONTAINS_FILE]->() OR n.name STARTS WITH 'nation_1' RETURN n.id", "SELECT id AS n_id FROM nodes n WHERE label = 'Nation' AND (NOT EXISTS (SELECT 1 FROM edges e WHERE e.source_id = n.id AND type = 'CONTAINS_FILE') OR lower(name) LIKE 'nation_1%')"),
    "count_star": ("MATCH (n) RETURN COUNT(*)", "SELECT count(*) AS count FROM nodes"),
    "count_hop": ("MATCH (a)-[:CALLS]->(b) WHERE a.kind = 'PROMO' RETURN COUNT(b) AS n", "SELECT count(*) AS n FROM edges JOIN nodes a ON a.id = source_id WHERE type = 'CALLS' AND kind = 'PROMO'"),
    "count_varpath": ("MATCH (a:Part)-[:CALLS*1..2]->(b) WHERE a.name = 'red widget' AND b.kind = 'SMALL' RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM (SELECT x.target_id AS b, x.source_id AS a FROM edges x WHERE x.type = 'CALLS' UNION ALL SELECT y.target_id, x.source_id FROM edges x JOIN edges y ON x.target_id = y.source_id AND y.target_id <> x.source_id WHERE x.type = 'CALLS' AND y.type = 'CALLS') p JOIN nodes a ON a.id = p.a JOIN nodes b ON b.id = p.b WHERE a.name = 'red widget' AND b.kind = 'SMALL'"),
    "distinct_return": ("MATCH (n) RETURN DISTINCT n.label, n.file_path", "SELECT DISTINCT label AS n_label, file_path AS n_file_path FROM nodes"),
    "order_limit": ("MATCH (n) RETURN n.id, n.name ORDER BY n.name, n.id DESC LIMIT 25", "SELECT id AS n_id, name AS n_name FROM nodes ORDER BY name, id DESC LIMIT 25"),
    "order_nulls_first": ("MATCH (n) RETURN n.id ORDER BY n.file_path, n.id LIMIT 40", "SELECT id AS n_id FROM nodes ORDER BY file_path NULLS FIRST, id LIMIT 40"),
    "with_pass_through": ("MATCH (a:Supplier)-[:MEMBER_OF]->(b) WITH a, b RETURN a.name, b.name", "SELECT a.name AS a_name, b.name AS b_name FROM edges JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id WHERE type = 'MEMBER_OF'"),
    "project_node": ("MATCH (p:Project) RETURN p.name, p.root_path", "SELECT 'tpch' AS p_name, '/data/tpch' AS p_root_path"),
}

for _name, (_text, _sql) in TEXTS.items():
    query(_sql, name=_name)(lambda s, d, t=_text: cypher(src.property_graph(s, d), t, src.PROJECT, whole=True))


@query("SELECT id AS n_id, name AS n_name FROM nodes ORDER BY name, id LIMIT 50 OFFSET 200")
def paging_offset(s, d):
    return cypher(src.property_graph(s, d), "MATCH (n) RETURN n.id, n.name ORDER BY n.name", limit=50, offset=200)


@query("SELECT id AS n_id FROM nodes ORDER BY id LIMIT 200")
def default_limit(s, d):
    return cypher(src.property_graph(s, d), "MATCH (n) RETURN n.id ORDER BY n.id LIMIT 5000")


WALK = GRAPH.replace("WITH", "WITH RECURSIVE", 1) + """, calls AS (SELECT DISTINCT source_id, target_id FROM edges WHERE type = 'CALLS'),
walk AS (SELECT 'p1' AS node_id, 0::BIGINT AS depth, ['p1'] AS path UNION ALL
  SELECT c.target_id, w.depth + 1, list_append(w.path, c.target_id) FROM walk w JOIN calls c ON c.source_id = w.node_id WHERE w.depth < 3 AND NOT list_contains(w.path, c.target_id)) """
for _name, _low, _high in (("varpath_1_2", 1, 2), ("varpath_bounded", 2, 3), ("varpath_zero", 0, 1)):
    query(f"SELECT b.id AS b_id, b.name AS b_name FROM walk JOIN nodes b ON b.id = node_id WHERE depth BETWEEN {_low} AND {_high}", WALK, _name)(
        lambda s, d, lo=_low, hi=_high: cypher(src.property_graph(s, d), f"MATCH (a:Part)-[:CALLS*{lo}..{hi}]->(b) WHERE a.id = 'p1' RETURN b.id, b.name", whole=True)
    )
