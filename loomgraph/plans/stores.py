"""Store changes, incremental classification, maintenance, traces and the change feed."""

from pyspark.sql import functions as F

from loomgraph.model import HASHES, PROJECTS, complete
from loomgraph.operators import store
from loomgraph.plans.registry import GRAPH, query
from loomgraph.sources import files as fs
from loomgraph.sources import tpch_graph as src
from loomgraph.streaming import feed


def _g(s, d):
    return src.property_graph(s, d)


NEW = "new AS (SELECT 'p' || l_partkey AS source_id, 's' || l_suppkey AS target_id, 'CALLS' AS type, round(1 - l_tax, 2) AS confidence, l_orderkey AS o FROM lineitem)"


def _new_edges(s, d):
    return src.table(s, d, "lineitem").select(
        F.lit("tpch").alias("project"), F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id"), F.lit("CALLS").alias("type"), F.lit("{}").alias("props"), F.round(1 - F.col("l_tax"), 2).alias("confidence"), F.col("l_orderkey").alias("o"),
    )


@query("SELECT source_id, target_id, type, arg_max(confidence, (o, confidence)) AS confidence FROM (SELECT *, -1 AS o FROM edges UNION ALL SELECT * FROM new WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)) GROUP BY 1, 2, 3", f"{GRAPH}, {NEW} ")
def edge_upsert_last_wins(s, d):
    return store.upsert_edges(_g(s, d), _new_edges(s, d), "o").edges.select("source_id", "target_id", "type", "confidence")


@query("SELECT id, CASE WHEN label = 'Part' AND start_line > 25 THEN 'renamed' ELSE name END AS name FROM nodes UNION ALL SELECT 'x' || r_regionkey, 'new' FROM region")
def node_upsert(s, d):
    g = _g(s, d)
    new = g.nodes.where("label = 'Part' AND start_line > 25").withColumn("name", F.lit("renamed"))
    more = src.table(s, d, "region").select(F.concat(F.lit("x"), "r_regionkey").alias("id"), F.lit("new").alias("name"))
    g = store.upsert_nodes(store.upsert_nodes(g, new), more)
    return g.nodes.select("id", "name")


@query("SELECT source_id, target_id, type, confidence FROM edges WHERE NOT (type = 'CALLS' AND source_id IN (SELECT source_id FROM new)) UNION ALL SELECT source_id, target_id, type, max(confidence) FROM new GROUP BY 1, 2, 3", f"{GRAPH}, {NEW} ")
def supersede_edges(s, d):
    new = _new_edges(s, d).groupBy("project", "source_id", "target_id", "type").agg(F.max("confidence").alias("confidence"))
    return store.supersede_edges(_g(s, d), new).edges.select("source_id", "target_id", "type", "confidence")


@query("SELECT source_id, target_id, type FROM edges WHERE source_id IN (SELECT id FROM nodes WHERE label IN ('Part', 'Nation')) AND target_id IN (SELECT id FROM nodes WHERE label IN ('Part', 'Nation'))")
def referential_filter(s, d):
    g = _g(s, d)
    return store.referential(g.edges, g.nodes, ["Part", "Nation"]).select("source_id", "target_id", "type")


GONE = "kept AS (SELECT * FROM nodes WHERE file_path IS NULL OR (file_path NOT IN ('Brand#1', 'Brand#2') AND NOT contains(file_path, '#1')))"


@query("SELECT source_id, target_id, type FROM edges WHERE source_id IN (SELECT id FROM kept) AND target_id IN (SELECT id FROM kept)", f"{GRAPH}, {GONE} ")
def delete_cascade(s, d):
    g = store.delete_nodes(_g(s, d), files=s.createDataFrame([("Brand#1",), ("Brand#2",)], "path string"))
    return store.delete_nodes(g, path_part="#1").edges.select("source_id", "target_id", "type")


@query("SELECT id, CASE WHEN kind = 'PROMO' THEN 'yes' END AS marked FROM nodes WHERE label = 'Part'")
def update_props(s, d):
    g = _g(s, d)
    new = src.parts(s, d).where(F.get_json_object("props", "$.kind") == "PROMO").select("id", F.lit('{"marked": "yes"}').alias("props"))
    return store.update_props(g, new).nodes.where("label = 'Part'").select("id", F.get_json_object("props", "$.marked").alias("marked"))


CATALOG = "SELECT 'd' || doc_id AS path, lang, sha256(text) AS h FROM documents WHERE text IS NOT NULL"


def _catalog(s, d):
    return src.table(s, d, "documents").where("text IS NOT NULL").select(F.concat(F.lit("d"), "doc_id").alias("rel_path"), F.coalesce("lang", F.lit("none")).alias("project"), F.sha2("text", 256).alias("content_hash"), F.col("n_chars").alias("mtime_ns"), F.col("n_chars").alias("size"))


@query(f"SELECT coalesce(lang, 'none') AS project, sha256(string_agg(path || chr(0) || h, chr(10) ORDER BY path)) AS catalog_hash FROM ({CATALOG}) GROUP BY 1", "")
def catalog_hash(s, d):
    return store.catalog_hash(_catalog(s, d))


@query("SELECT 'd' || doc_id AS rel_path, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL", "")
def content_hash(s, d):
    return _catalog(s, d).select("rel_path", "content_hash")


@query("""SELECT 'd' || doc_id AS path, CASE WHEN lang IS NULL OR lang = 'es' THEN 'added' WHEN lang = 'de' THEN 'changed' ELSE 'unchanged' END AS state FROM documents WHERE text IS NOT NULL""", "")
def classify_changes(s, d):
    """Stored rows lack Spanish and unmarked files; French ones were touched, German ones touched and edited."""
    now = _catalog(s, d)
    then = now.where("project NOT IN ('es', 'none')").withColumn("mtime_ns", F.when(F.col("project").isin("fr", "de"), 0).otherwise(F.col("mtime_ns")))
    return store.classify(now, then.withColumn("content_hash", F.when(F.col("project") == "de", "old").otherwise(F.col("content_hash"))))


@query("SELECT DISTINCT 'c' || conv_id || '-' || turn AS rel_path FROM conversations", "")
def prune_deleted(s, d):
    stored = src.table(s, d, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("rel_path")).distinct()
    return store.deleted(stored.unionByName(_catalog(s, d).select("rel_path")), _catalog(s, d))


@query("SELECT 'd' || doc_id AS rel_path FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang = 'en'", "")
def hint_subset(s, d):
    hints = src.table(s, d, "documents").where("source IS NOT NULL AND lang = 'en'").select(F.concat(F.lit("d"), "doc_id").alias("path")).unionByName(s.createDataFrame([("unknown",)], "path string"))
    return store.hinted(_catalog(s, d), hints).select("rel_path")


@query("SELECT 'd' || doc_id AS rel_path FROM documents WHERE text IS NOT NULL AND (lang IS NULL OR lang IN ('de', 'fr', 'es')) UNION ALL SELECT DISTINCT 'c' || conv_id FROM conversations", "")
def stale_files(s, d):
    now = _catalog(s, d)
    then = now.where("project NOT IN ('es', 'none')").withColumn("size", F.when(F.col("project").isin("fr", "de"), F.col("size") + 1).otherwise(F.col("size"))).select("rel_path", "mtime_ns", "size")
    gone = src.table(s, d, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("rel_path"), F.lit(0).cast("long").alias("mtime_ns"), F.lit(1).cast("long").alias("size")).distinct()
    return fs.stale(now, then.unionByName(gone))


@query("SELECT count(*) || ':' || coalesce(sum(n_chars), 0) AS signature FROM (SELECT n_chars FROM documents WHERE text IS NOT NULL ORDER BY 'd' || doc_id LIMIT 2000)", "")
def source_signature(s, d):
    return fs.signature(_catalog(s, d))


NOW = 1_000_000_000_000
OPENED = "SELECT c_custkey, coalesce(max(epoch_ms(o_orderdate)), 0) AS t FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"


def _projects(s, d):
    opened = src.table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("t"))
    rows = src.table(s, d, "customer").join(opened, "c_custkey", "left").select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.coalesce("t", F.lit(0)).alias("last_opened_at"))
    return complete(rows, PROJECTS)


@query(f"SELECT 'c' || c_custkey AS name FROM ({OPENED}) WHERE t <> 0 AND t < {NOW - 400 * 86_400_000}", "")
def gc_expired(s, d):
    return store.expired(_projects(s, d), NOW, 400).select("name")


@query(f"SELECT 'c' || c_custkey AS name, CASE WHEN c_nationkey < 5 THEN '/new' END AS root_path, t AS last_opened_at FROM ({OPENED}) JOIN customer USING (c_custkey) UNION ALL SELECT 'n' || n_nationkey, '/new', 0 FROM nation", "")
def project_upsert(s, d):
    from loomgraph.model import Graph

    new = src.table(s, d, "customer").where("c_nationkey < 5").select(F.concat(F.lit("c"), "c_custkey").alias("name")).unionByName(src.table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("name")))
    g = Graph(src.nodes(s, d), src.edges(s, d), _projects(s, d))
    return store.upsert_projects(g, new.withColumn("root_path", F.lit("/new"))).projects.select("name", "root_path", "last_opened_at")


@query("SELECT rel_path, count(*) OVER () AS n FROM (SELECT DISTINCT 'd' || doc_id AS rel_path FROM documents WHERE text IS NOT NULL)", "")
def hash_upsert(s, d):
    from loomgraph.model import Graph

    g = Graph(src.nodes(s, d), src.edges(s, d), None, s.createDataFrame([], HASHES))
    g = store.upsert_hashes(store.upsert_hashes(g, _catalog(s, d).withColumn("project", F.lit("x"))), _catalog(s, d).withColumn("project", F.lit("x")))
    total = g.hashes.agg(F.count(F.lit(1)).alias("n"))
    return g.hashes.select("rel_path").join(F.broadcast(total))  # one row


@query("SELECT 'n' || n_nationkey AS source_id, 'r' || n_regionkey AS target_id, 'MEMBER_OF' AS type FROM nation WHERE n_nationkey > 2", "")
def trace_ingest_json(s, d):
    item = F.struct(F.concat(F.lit("n"), "n_nationkey").alias("fromId"), F.concat(F.lit("r"), "n_regionkey").alias("toId"), F.when(F.col("n_nationkey") > 2, "MEMBER_OF").alias("type"), F.lit(1.5).alias("weight"))
    texts = src.table(s, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(item)).alias("traces"))
    return fs.traces(texts).select("source_id", "target_id", "type")


@query("""SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_events FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM (
  SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 3600 SECOND THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, b""", "")
def debounce_sessions(s, d):
    return feed.debounce(src.table(s, d, "events").select("user_id", "ts"), "3600 seconds", key="user_id")


