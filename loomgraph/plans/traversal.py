"""Walks, traces, risk, impact and PageRank."""

from pyspark.sql import functions as F

from loomgraph.operators import paths, rank, search
from loomgraph.plans.language import WALK
from loomgraph.plans.registry import GRAPH, query
from loomgraph.sources import tpch_graph as src


def _g(s, d):
    return src.property_graph(s, d)


def _start(s, d):
    return s.createDataFrame([("p1",)], "id string")


def _joined(df):
    return df.select("node_id", "depth", F.array_join("path", ">").alias("path"))


INBOUND = WALK.replace("c.target_id", "c._x").replace("c.source_id", "c.target_id").replace("c._x", "c.source_id")
ROWS = "SELECT node_id, depth, array_to_string(path, '>') AS path FROM walk WHERE depth > 0 ORDER BY depth, path LIMIT 200"
LEAST = "SELECT node_id, min(depth) AS depth FROM walk WHERE depth > 0 GROUP BY 1"


@query(ROWS, WALK)
def bfs_paths_out(s, d):
    return _joined(paths.bfs_paths(_g(s, d), _start(s, d), ["CALLS"], False, 3))


@query(ROWS, INBOUND)
def bfs_paths_in(s, d):
    return _joined(paths.bfs_paths(_g(s, d), _start(s, d), ["CALLS"], True, 3))


@query(ROWS.replace("LIMIT 200", ""), WALK.replace("type = 'CALLS'", "type = 'CALLS' AND confidence >= 0.95"))
def bfs_min_confidence(s, d):
    return _joined(paths.bfs_paths(_g(s, d), _start(s, d), ["CALLS"], False, 3, None, 0.95))


@query(LEAST, INBOUND)
def bfs_min_depth(s, d):
    return paths.bfs_nodes(_start(s, d), _g(s, d).edges.where("type = 'CALLS'"), 3, True).select("node_id", "depth")


RISK = """CASE WHEN (entry AND depth <= 1) OR k > 10 THEN 'CRITICAL' WHEN k > 5 OR depth <= 1 THEN 'HIGH' WHEN k > 2 OR depth <= 2 THEN 'MEDIUM' ELSE 'LOW' END"""
RISKY = f"""SELECT node_id, depth, {RISK} AS risk FROM (SELECT l.*, coalesce(n.entry, false) AS entry, coalesce(i.k, 0) AS k FROM ({LEAST}) l
  LEFT JOIN nodes n ON n.id = node_id LEFT JOIN (SELECT target_id, count(*) AS k FROM edges WHERE type IN ('CALLS', 'ASYNC_CALLS') GROUP BY 1) i ON i.target_id = node_id)"""


@query(RISKY, INBOUND)
def trace_with_risk(s, d):
    g = _g(s, d)
    return paths.with_risk(g, paths.bfs_nodes(_start(s, d), g.edges.where("type = 'CALLS'"), 3, True)).select("node_id", "depth", "risk")


@query(f"SELECT v AS risk, count(r.risk) AS n FROM (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW']) AS v) LEFT JOIN ({RISKY}) r ON r.risk = v GROUP BY 1", INBOUND)
def risk_summary(s, d):
    return paths.risk_summary(trace_with_risk(s, d))


@query("SELECT depth, string_agg(node_id, ',' ORDER BY node_id) AS node_ids FROM (SELECT DISTINCT depth, node_id FROM walk WHERE depth BETWEEN 1 AND 2) GROUP BY 1", WALK)
def trace_levels(s, d):
    found = paths.bfs_paths(_g(s, d), _start(s, d), ["CALLS"], False, 2, None)
    return paths.by_depth(found).select("depth", F.array_join("node_ids", ",").alias("node_ids"))


TRACED = WALK.replace("type = 'CALLS'", "type IN ('CALLS', 'ASYNC_CALLS', 'HTTP_CALLS')").replace("'p1'", "(SELECT min(id) FROM nodes WHERE name = 'blue bolt')").replace("w.depth < 3", "w.depth < 2")
@query("SELECT node_id, depth FROM (SELECT * FROM walk WHERE depth > 0 ORDER BY depth, array_to_string(path, '>') LIMIT 200) QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY depth, array_to_string(path, '>')) = 1", TRACED)
def trace_by_name(s, d):
    return paths.trace(_g(s, d), "blue bolt", "outbound", 2)[0].select("node_id", "depth")


SEEDS = "s AS (SELECT id FROM nodes WHERE name = 'red widget')"
HOPS = f"""SELECT id, min(hop)::BIGINT AS hop FROM (SELECT source_id AS id, 1 AS hop FROM edges JOIN s ON target_id = s.id
  UNION ALL SELECT y.source_id, 2 FROM edges x JOIN s ON x.target_id = s.id JOIN edges y ON y.target_id = x.source_id) WHERE id NOT IN (SELECT id FROM s) GROUP BY 1"""


@query(HOPS, f"{GRAPH}, {SEEDS} ")
def expand_callers_2hop(s, d):
    g = _g(s, d)
    return paths.expand_callers(g, g.nodes.where("name = 'red widget'").select("id"), 2).select("id", "hop")


CHANGED = "s AS (SELECT id FROM nodes WHERE file_path IN ('Brand#17', 'Brand#4') AND label = 'Part')"
REACHED = "SELECT source_id AS node_id, 1 AS depth FROM c JOIN s ON target_id = s.id UNION ALL SELECT y.source_id, 2 FROM c x JOIN s ON x.target_id = s.id JOIN c y ON y.target_id = x.source_id AND y.source_id <> x.target_id"


@query(f"""SELECT node_id, depth, {RISK} AS risk FROM (SELECT r.node_id, min(depth)::BIGINT AS depth, any_value(coalesce(n.entry, false)) AS entry, any_value(coalesce(i.k, 0)) AS k FROM ({REACHED}) r
  LEFT JOIN nodes n ON n.id = r.node_id LEFT JOIN (SELECT target_id, count(*) AS k FROM edges WHERE type IN ('CALLS', 'ASYNC_CALLS') GROUP BY 1) i ON i.target_id = r.node_id
  WHERE r.node_id NOT IN (SELECT id FROM s) GROUP BY 1)""", f"{GRAPH}, c AS (SELECT DISTINCT source_id, target_id FROM edges WHERE type IN ('CALLS', 'ASYNC_CALLS', 'HTTP_CALLS')), {CHANGED} ")  # fmt: skip
def impact_callers(s, d):
    changes = s.createDataFrame([("Brand#17", "modified"), ("Brand#4", "added"), ("Brand#3", "deleted")], "path string, status string")
    return paths.impact(_g(s, d), changes, 2, labels=["Part"], max_rows=None).select("node_id", "depth", "risk")


@query("SELECT id, 0::BIGINT AS hop FROM s UNION ALL " + HOPS, f"{GRAPH}, {CHANGED} ")
def session_impact(s, d):
    return paths.session_impact(_g(s, d), s.createDataFrame([("Brand#17",), ("Brand#4",)], "path string")).select("id", "hop")


@query("SELECT id, file_path FROM nodes WHERE label = 'Part' AND file_path IN ('Brand#17', 'Brand#4')")
def changed_symbols(s, d):
    changes = s.createDataFrame([("Brand#17", "modified"), ("Brand#4", "added"), ("Brand#3", "deleted")], "path string, status string")
    return paths.changed_symbols(_g(s, d), changes, ["Part"]).select("id", "file_path")


@query("SELECT node_id, min(depth) AS depth, arg_min(array_to_string(path, '>'), (depth, array_to_string(path, '>'))) AS path FROM walk WHERE depth > 0 GROUP BY 1", WALK)
def call_path_shortest(s, d):
    found = _joined(paths.bfs_paths(_g(s, d), _start(s, d), ["CALLS"], False, 3, None))
    return found.groupBy("node_id").agg(F.min("depth").alias("depth"), F.min_by("path", F.struct("depth", "path")).alias("path"))


def _rank_sql(rounds: int, teleport: str = "1.0::DOUBLE / n") -> str:
    start = f""", v AS MATERIALIZED (SELECT id, count(*) OVER ()::DOUBLE AS n FROM nodes WHERE label = 'Part'),
 l AS MATERIALIZED (SELECT source_id, target_id, count(*) AS k, sum(count(*)) OVER (PARTITION BY source_id) AS o FROM edges WHERE type IN ('CALLS', 'ASYNC_CALLS', 'HTTP_CALLS') GROUP BY 1, 2),
 p0 AS MATERIALIZED (SELECT id, 1 / n AS r, {teleport} AS t, NOT EXISTS (SELECT 1 FROM l WHERE source_id = id) AS sink FROM v)"""
    step = ", p{1} AS MATERIALIZED (SELECT p.id, 0.15 * t + 0.85 * (coalesce(f.x, 0) + CASE WHEN sink THEN 0.1 * r ELSE 0 END) AS r, t, sink FROM p{0} p LEFT JOIN (SELECT target_id, sum(r * 0.9 * k / o) AS x FROM l JOIN p{0} q ON q.id = source_id GROUP BY 1) f ON f.target_id = p.id)"
    return start + "".join(step.format(i, i + 1) for i in range(rounds)) + " "


def _rank(s, d, rounds, seeds=None):
    return rank.pagerank(src.parts(s, d), src.calls(s, d), seeds, rounds=rounds, epsilon=0.0)


SEEDED = "CASE id WHEN 'p0' THEN 0.5 WHEN 'p10' THEN 0.3 WHEN 'p50' THEN 0.2 ELSE 1 / n END"


def _seeds(s):
    return s.createDataFrame([("p0", 5.0), ("p10", 3.0), ("p50", 2.0), ("unknown", 9.0)], "id string, weight double")


@query("SELECT id, round(r, 9) AS score FROM p5", GRAPH + _rank_sql(5))
def pagerank_5iter(s, d):
    return _rank(s, d, 5).select("id", F.round("score", 9).alias("score"))


@query("SELECT id, round(r, 9) AS score FROM p20", GRAPH + _rank_sql(20))
def pagerank_20iter(s, d):
    return _rank(s, d, 20).select("id", F.round("score", 9).alias("score"))


@query("SELECT id, round(r, 9) AS score FROM p5", GRAPH + _rank_sql(5, SEEDED))
def pagerank_seeded(s, d):
    return _rank(s, d, 5, _seeds(s)).select("id", F.round("score", 9).alias("score"))


@query("SELECT file_path, round(max(r), 9) AS score FROM p5 JOIN nodes USING (id) WHERE r > 0 AND file_path IS NOT NULL GROUP BY 1", GRAPH + _rank_sql(5))
def pagerank_file_max(s, d):
    return rank.file_scores(src.parts(s, d), _rank(s, d, 5)).select("file_path", F.round("score", 9).alias("score"))


@query("SELECT id, round(r / max(r) OVER (), 6) AS score FROM p5", GRAPH + _rank_sql(5))
def pagerank_normalised(s, d):
    return rank.normalise(_rank(s, d, 5)).select("id", F.round("score", 6).alias("score"))


@query("SELECT 'dependency' AS direction, target_id AS id, type FROM edges WHERE source_id = 'p1' UNION ALL SELECT 'dependent', source_id, type FROM edges WHERE target_id = 'p1'")
def dependencies(s, d):
    return search.dependencies(_g(s, d), "p1").select("direction", "id", "type")
