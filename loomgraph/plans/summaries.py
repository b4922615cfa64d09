"""Degrees, counts, schema, search, code search and the older model."""

from pyspark.sql import functions as F

from loomgraph import functions as fn
from loomgraph.operators import search
from loomgraph.plans.registry import GRAPH, query
from loomgraph.sources import files as fs
from loomgraph.sources import tpch_graph as src

CALLS = ["CALLS", "ASYNC_CALLS"]


def _g(s, d):
    return src.property_graph(s, d)


def _count(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


query("SELECT label, count(*) AS n FROM nodes GROUP BY 1", name="label_counts")(lambda s, d: search.label_counts(src.nodes(s, d)))
query("SELECT type, count(*) AS n FROM edges GROUP BY 1", name="type_counts")(lambda s, d: search.type_counts(src.edges(s, d)))
query("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges", name="graph_totals")(lambda s, d: search.totals(_g(s, d)))
query("SELECT DISTINCT a.label AS source_label, type, b.label AS target_label FROM edges JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id", name="relationship_patterns")(lambda s, d: search.relationship_patterns(_g(s, d)))
query("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT file_path) FROM nodes) AS files", name="legacy_counts")(lambda s, d: search.legacy_counts(_g(s, d)))
query("SELECT 'tpch' AS name, (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count", name="list_projects")(lambda s, d: search.projects(_g(s, d)).select("name", "node_count", "edge_count"))

ENDS = "SELECT unnest(list_distinct([source_id, target_id])) AS id FROM edges"
DEGREES = f"SELECT n.*, coalesce(k, 0) AS degree FROM nodes n LEFT JOIN (SELECT id, count(*) AS k FROM ({ENDS}) GROUP BY 1) USING (id)"


@query(f"SELECT id, degree FROM ({DEGREES})")
def node_degree_both(s, d):
    return search.degrees(src.nodes(s, d), src.edges(s, d)).select("id", "degree")


@query("SELECT a.id, coalesce(i, 0) AS inbound, coalesce(o, 0) AS outbound FROM nodes a LEFT JOIN (SELECT target_id AS id, count(*) AS i FROM edges WHERE type = 'CALLS' GROUP BY 1) USING (id) LEFT JOIN (SELECT source_id AS id, count(*) AS o FROM edges WHERE type = 'CALLS' GROUP BY 1) USING (id) WHERE label = 'Part'")
def node_degree_split(s, d):
    e = src.edges(s, d)
    n = search.degrees(src.parts(s, d).select("id"), e, ["CALLS"], "inbound").withColumnRenamed("degree", "inbound")
    return search.degrees(n, e, ["CALLS"], "outbound").withColumnRenamed("degree", "outbound")


@query(f"SELECT id FROM ({DEGREES.replace('FROM edges', 'FROM edges WHERE type = ' + chr(39) + 'CALLS' + chr(39))}) WHERE degree BETWEEN 8 AND 14 AND label = 'Part'")
def degree_min_max(s, d):
    return search.search_nodes(_g(s, d), label="Part", types=["CALLS"], min_degree=8, max_degree=14).select("id")


@query("SELECT n.id FROM nodes n LEFT JOIN (SELECT target_id, count(*) AS k FROM edges WHERE type IN ('CALLS', 'ASYNC_CALLS') GROUP BY 1) ON target_id = n.id WHERE coalesce(k, 0) <= 9 AND label = 'Part'")
def degree_union_types(s, d):
    return search.search_nodes(_g(s, d), label="Part", types=CALLS, direction="inbound", max_degree=9).select("id")


@query(f"SELECT id, degree FROM ({DEGREES}) WHERE label = 'Part' ORDER BY degree DESC, id LIMIT 20")
def hotspots_top20(s, d):
    return search.hotspots(_g(s, d), ["Part"])


@query("SELECT id, name FROM nodes WHERE project = 'tpch' AND label = 'Part' AND lower(name) LIKE '%ring%' AND lower(file_path) LIKE '%brand#1%' AND NOT entry ORDER BY name, id LIMIT 100 OFFSET 5")
def filtered_search(s, d):
    found = search.search_nodes(_g(s, d), "RING", "Part", "tpch", "brand#1", exclude_entry_points=True)
    return search.page(found, 100, 5)[0].select("id", "name")


@query("SELECT id FROM nodes WHERE contains(name, 'ring') AND contains(file_path, 'Brand#2')")
def case_sensitive_search(s, d):
    return search.search_nodes(_g(s, d), "ring", file_pattern="Brand#2", case_sensitive=True).select("id")


@query("SELECT id, CASE WHEN name = 'Red widget' THEN 0 WHEN lower(name) LIKE 'red widget%' THEN 1 ELSE 2 END AS rank FROM nodes WHERE lower(name) LIKE '%red widget%'")
def ranked_search(s, d):
    return search.search_ranked(src.nodes(s, d), "Red widget").select("id", "rank")


RANKED = "SELECT id, name, CASE WHEN name = 'red' THEN 0 WHEN lower(name) LIKE 'red%' THEN 1 ELSE 2 END AS rank FROM nodes WHERE lower(name) LIKE '%red%'"


@query(f"SELECT id, rank, row_number() OVER (PARTITION BY rank ORDER BY name, id) = 1 AS heading FROM ({RANKED})")
def ranked_headings(s, d):
    return search.rank_headings(search.search_ranked(src.nodes(s, d), "red")).select("id", "rank", "heading")


@query("SELECT id, CASE WHEN lower(name) = 'hot gear' THEN 100 WHEN lower(name) LIKE 'hot gear%' THEN 80 ELSE 60 END AS score FROM nodes WHERE lower(name) LIKE '%hot gear%' ORDER BY score DESC, name, id LIMIT 20")
def scored_search(s, d):
    return search.search_scored(src.nodes(s, d), "Hot Gear", 20).select("id", "score")


@query("SELECT id FROM nodes WHERE lower(name) LIKE '%d#1%' OR lower(id) LIKE '%d#1%' OR lower(file_path) LIKE '%d#1%'")
def trigram_search(s, d):
    return search.search_trigram(src.nodes(s, d), "D#1").select("id")


@query("SELECT t AS trigram, count(*) AS n FROM (SELECT DISTINCT id, substr(x, i::BIGINT, 3) AS t FROM (SELECT id, lower(concat_ws(chr(10), name, id, file_path)) AS x FROM nodes), unnest(range(1, length(x) - 1)) u(i)) GROUP BY 1")
def trigram_index(s, d):
    return _count(search.trigrams(src.nodes(s, d)), "trigram")


@query("SELECT coalesce(lang, 'unknown') AS language, count(*) AS n FROM documents GROUP BY 1", "")
def languages(s, d):
    bag = F.to_json(F.struct(F.col("lang").alias("language")))
    return search.languages(src.table(s, d, "documents").select(F.lit("File").alias("label"), bag.alias("props")))


LAYER = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(p, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in search.LAYERS) + " END"


@query(f"SELECT layer, string_agg(name, ',' ORDER BY name) AS folders FROM (SELECT name, {LAYER} AS layer FROM (SELECT DISTINCT c_mktsegment AS name, lower(c_mktsegment) AS p FROM customer UNION SELECT o_orderpriority, lower(o_orderpriority) FROM orders)) WHERE layer IS NOT NULL GROUP BY 1", "")
def layers(s, d):
    names = src.table(s, d, "customer").select(F.col("c_mktsegment").alias("name")).union(src.table(s, d, "orders").select("o_orderpriority")).distinct()
    return search.layers(names.withColumn("path", F.col("name"))).select("layer", F.array_join("folders", ",").alias("folders"))


@query("SELECT path, repeat('  ', len(string_split(path, '/')) - 1) || list_extract(string_split(path, '/'), -1) AS line FROM (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS path FROM pages)", "")
def file_tree(s, d):
    return search.file_tree(src.table(s, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")))


@query("SELECT id FROM (SELECT * FROM nodes WHERE label = 'Part' ORDER BY name, id LIMIT 1000) WHERE entry")
def entry_points(s, d):
    return search.entry_points(src.parts(s, d).withColumn("label", F.lit("Function"))).select("id")


LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents"


@query(f"SELECT doc_id, pos AS line_no, substr(line, 1, 200) AS line, instr(lower(line), 'license') - 1 AS match_start, instr(lower(line), 'license') + 6 AS match_end FROM ({LINES}) WHERE lower(line) LIKE '%license%'", "")
def code_search_lines(s, d):
    found = search.search_code(src.table(s, d, "documents").select(F.col("doc_id").alias("path"), "text"), "license")
    return found.withColumnRenamed("path", "doc_id")


@query(f"SELECT doc_id, pos AS line_no FROM ({LINES}) WHERE regexp_matches(line, '[0-9]{{3}}-[0-9]{{4}}')", "")
def code_search_regex(s, d):
    found = search.search_code(src.table(s, d, "documents").select(F.col("doc_id").alias("path"), "text"), "[0-9]{3}-[0-9]{4}", regex=True)
    return found.select(F.col("path").alias("doc_id"), "line_no")


@query(f"SELECT doc_id AS path, pos AS line_no, md5(line) AS line_md5 FROM ({LINES})", "")
def source_lines(s, d):
    lines = fs.source_lines(src.table(s, d, "documents").select("doc_id", "text"), "doc_id")
    return lines.select("path", "line_no", F.md5(F.encode("line", "UTF-8")).alias("line_md5"))


@query("SELECT 'p' || p_partkey AS id, md5(array_to_string(string_split(text, chr(10))[p_size:p_size + 10], chr(10))) AS snippet_md5 FROM part JOIN documents ON 'd' || doc_id = 'd' || p_partkey WHERE text IS NOT NULL", "")
def snippets(s, d):
    n = src.parts(s, d).withColumn("file_path", F.regexp_replace("id", "^p", "d"))
    got = search.snippets(n, src.table(s, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), "text").where("text IS NOT NULL"))
    return got.select("id", F.md5(F.encode("snippet", "UTF-8")).alias("snippet_md5"))


LEGACY_LABEL = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in search.LEGACY_LABELS.items()) + " ELSE 'variable' END"
LEGACY_TYPE = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in search.LEGACY_TYPES.items()) + " ELSE 'depends_on' END"


@query(f"SELECT source_id AS source, target_id AS target, {LEGACY_TYPE} AS type FROM edges")
def legacy_projection(s, d):
    return search.legacy_projection(_g(s, d))[1]


@query(f"SELECT coalesce(file_path, '') || '::' || name || '::' || {LEGACY_LABEL} || '::' || coalesce(start_line, 0) AS id, name FROM nodes")
def legacy_nodes(s, d):
    return search.legacy_projection(_g(s, d))[0].select("id", "name")


@query("SELECT id FROM (SELECT * FROM nodes WHERE lower(name) LIKE '%nation_7%' ORDER BY name, id LIMIT 10) WHERE name = 'NATION_7' LIMIT 1")
def legacy_id_lookup(s, d):
    return search.node_by_legacy_id(_g(s, d), "x::NATION_7::variable::0").select("id")


@query("""SELECT event_id, list_extract(string_split(event_type || '/' || user_id, '/'), -1) AS base, event_type AS dir, lpad(user_id::VARCHAR, 8, '0') AS padded,
  epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS iso, least(greatest(value, 2.0), 9.0) AS clamped, sha256(props) AS hash,
  json_extract_string(props, '$.k') AS k FROM events""", "")
def scalar_functions(s, d):
    path = F.concat_ws("/", "event_type", "user_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return src.table(s, d, "events").select(
        "event_id", fn.basename(path).alias("base"), fn.dirname(path).alias("dir"), fn.pad_start(F.col("user_id").cast("string"), 8, "0").alias("padded"), ms.alias("ms"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"), fn.clamp(F.col("value"), 2.0, 9.0).alias("clamped"), F.sha2("props", 256).alias("hash"), F.get_json_object("props", "$.k").alias("k"),
    )
