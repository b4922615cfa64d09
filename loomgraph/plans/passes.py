"""Resolution passes, over extraction tables derived from the relational ones."""

from pyspark.sql import functions as F

from loomgraph.operators import graph as g
from loomgraph.operators import resolve as r
from loomgraph.plans.registry import query
from loomgraph.sources import tpch_graph as src

# Extraction tables: definitions from suppliers, calls from parts, imports from customers.
TABLES = """WITH defs AS (
  SELECT 'src/Brand' || (s_suppkey % 25 + 1) || '.ts' AS path, s_suppkey::BIGINT AS ordinal, p_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'Function' WHEN 1 THEN 'Method' ELSE 'Class' END AS kind,
    s_nationkey + 1 AS start_line, s_nationkey + 15 AS end_line, 'tpch.src.Brand' || (s_suppkey % 25 + 1) || '.' || p_name AS id FROM supplier JOIN part ON p_partkey = s_suppkey),
calls AS (
  SELECT 'src/' || replace(p_brand, '#', '') || '.ts' AS path, p_partkey AS ordinal, p_name AS callee, p_size AS line, p_type = 'PROMO' AS is_new, p_type = 'SMALL' AS is_async FROM part),
imports AS (
  SELECT 'src/Brand' || (c_custkey % 25 + 1) || '.ts' AS path, c_custkey AS ordinal, p_name AS name, CASE WHEN c_nationkey < 20 THEN './Brand' || (c_nationkey + 1) WHEN c_nationkey < 22 THEN '@scope/' || lower(c_mktsegment) || '/x' ELSE 'lib/y' END AS source,
    c_mktsegment = 'BUILDING' AS is_type_only FROM customer JOIN part ON p_partkey = c_custkey) """


def _path(key):
    return F.concat(F.lit("src/Brand"), F.col(key) % 25 + 1, F.lit(".ts"))


def _names(s, d, key):
    return src.table(s, d, "part").select(F.col("p_partkey").alias(key), F.col("p_name").alias("name"))


def definitions(s, d):
    kind = F.when(F.col("s_suppkey") % 3 == 0, "Function").when(F.col("s_suppkey") % 3 == 1, "Method").otherwise("Class")
    rows = src.table(s, d, "supplier").join(_names(s, d, "s_suppkey"), "s_suppkey").select(
        _path("s_suppkey").alias("path"), F.col("s_suppkey").alias("ordinal"), "name", kind.alias("kind"), (F.col("s_nationkey") + 1).alias("start_line"), (F.col("s_nationkey") + 15).alias("end_line")
    )
    return r.symbols(rows, "tpch")


def calls(s, d):
    return src.table(s, d, "part").select(
        F.concat(F.lit("src/"), F.regexp_replace("p_brand", "#", ""), F.lit(".ts")).alias("path"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("callee"), F.col("p_size").alias("line"),
        (F.col("p_type") == "PROMO").alias("is_new"), (F.col("p_type") == "SMALL").alias("is_async"),
    )


def imports(s, d):
    source = F.when(F.col("c_nationkey") < 20, F.concat(F.lit("./Brand"), F.col("c_nationkey") + 1)).when(F.col("c_nationkey") < 22, F.concat(F.lit("@scope/"), F.lower("c_mktsegment"), F.lit("/x"))).otherwise("lib/y")
    return src.table(s, d, "customer").join(_names(s, d, "c_custkey"), "c_custkey").select(
        _path("c_custkey").alias("path"), F.col("c_custkey").alias("ordinal"), "name", F.lit(None).cast("string").alias("original"), source.alias("source"), (F.col("c_mktsegment") == "BUILDING").alias("is_type_only")
    )


HELD = """held AS (SELECT c.*, arg_min(f.id, f.ordinal) AS caller FROM calls c JOIN defs f ON f.path = c.path AND f.kind IN ('Function', 'Method') AND c.line BETWEEN f.start_line AND f.end_line GROUP BY ALL)"""


@query("SELECT ordinal, caller FROM held", f"{TABLES}, {HELD} ")
def enclosing_interval_join(s, d):
    return r.enclosing(calls(s, d), definitions(s, d)).select("ordinal", "caller")


IMPORTED = """uniq AS (SELECT name, min(id) AS id FROM defs GROUP BY 1 HAVING count(DISTINCT id) = 1),
imp AS (SELECT i.path, i.name, arg_min(f.id, (i.ordinal, f.id)) AS target FROM imports i JOIN defs f USING (name) LEFT JOIN uniq u USING (name)
  WHERE NOT is_type_only AND (u.id IS NOT NULL OR contains(f.id, replace(regexp_replace(source, '^(\\.{1,2}/)+|^@?/', ''), '/', '.'))) GROUP BY 1, 2)"""


@query("SELECT path, name, target FROM imp", f"{TABLES}, {IMPORTED} ")
def imported_symbols(s, d):
    return r.imported_symbols(imports(s, d), definitions(s, d))


@query("""SELECT caller AS source_id, target AS target_id, type, arg_min(confidence, (path, ordinal)) AS confidence, arg_min(method, (path, ordinal)) AS resolution_method FROM (
  SELECT path, ordinal, caller, CASE WHEN is_async THEN 'ASYNC_CALLS' ELSE 'CALLS' END AS type, coalesce(a, b, c, k) AS target,
    CASE WHEN a IS NOT NULL THEN 0.95 WHEN b IS NOT NULL THEN 0.85 WHEN c IS NOT NULL THEN 0.80 ELSE 0.65 END::DOUBLE AS confidence,
    CASE WHEN a IS NOT NULL THEN 'import' WHEN b IS NOT NULL THEN 'same_file' WHEN c IS NOT NULL THEN 'unique_name' ELSE 'class' END AS method FROM (
    SELECT h.*, imp.target AS a, o.id AS b, u.id AS c, CASE WHEN is_new THEN cl.id END AS k FROM held h LEFT JOIN imp ON imp.path = h.path AND imp.name = callee
      LEFT JOIN (SELECT path, name, arg_min(id, (ordinal, id)) AS id FROM defs GROUP BY 1, 2) o ON o.path = h.path AND o.name = callee LEFT JOIN uniq u ON u.name = callee
      LEFT JOIN (SELECT name, min(id) AS id FROM defs WHERE kind = 'Class' GROUP BY 1) cl ON cl.name = callee)) WHERE target IS NOT NULL AND target <> caller GROUP BY 1, 2, 3""", f"{TABLES}, {HELD}, {IMPORTED} ")  # fmt: skip
def call_resolution_tiers(s, d):
    return r.resolve_calls(calls(s, d), imports(s, d), definitions(s, d))


@query("""SELECT DISTINCT regexp_replace(replace(i.path, '/', '.'), '\\.ts$', '') AS s, 'src.' || substr(source, 3) AS t FROM imports i WHERE source LIKE './%' AND source[3:] IN (SELECT replace(p_brand, '#', '') FROM part)
  UNION SELECT regexp_replace(replace(path, '/', '.'), '\\.ts$', ''), '__pkg_' || regexp_replace(CASE WHEN source LIKE '@%' THEN split_part(source, '/', 1) || '/' || split_part(source, '/', 2) ELSE split_part(source, '/', 1) END, '[^a-zA-Z0-9]', '_', 'g') FROM imports WHERE source NOT LIKE '.%'""", TABLES)  # fmt: skip
def import_resolution(s, d):
    files = calls(s, d).select("path").distinct()
    edges = r.import_edges(imports(s, d), files, "tpch")[0]
    return edges.select(F.substring("source_id", 6, 999).alias("s"), F.substring("target_id", 6, 999).alias("t"))


HEIRS = """WITH cls AS (SELECT 'src/' || replace(p_brand, '#', '') || '.ts' AS path, p_partkey AS ordinal, p_name AS name, CASE WHEN p_size > 10 THEN 'Class' ELSE 'Interface' END AS kind,
  'tpch.src.' || replace(p_brand, '#', '') || '.' || p_name AS id, CASE WHEN p_size > 25 THEN 'red ' || split_part(p_name, ' ', 2) END AS up, p_type = 'PROMO' AS impl FROM part),
base AS (SELECT name, arg_min(id, (path, ordinal)) AS id FROM cls GROUP BY 1) """


@query("SELECT DISTINCT c.id AS source_id, b.id AS target_id, 'EXTENDS' AS type FROM cls c JOIN base b ON b.name = up WHERE c.id <> b.id UNION SELECT c.id, b.id, 'IMPLEMENTS' FROM cls c JOIN base b ON b.name = 'hot gear' WHERE impl AND c.id <> b.id", HEIRS)
def heritage_edges(s, d):
    base = F.when(F.col("p_size") > 25, F.concat(F.lit("red "), F.element_at(F.split("p_name", " "), 2)))
    rows = src.table(s, d, "part").select(
        F.concat(F.lit("src/"), F.regexp_replace("p_brand", "#", ""), F.lit(".ts")).alias("path"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") > 10, "Class").otherwise("Interface").alias("kind"), base.alias("extends_clause"), F.when(F.col("p_type") == "PROMO", F.array(F.lit("hot gear"))).otherwise(F.array().cast("array<string>")).alias("implements"),
    )
    return r.heritage(r.symbols(rows, "tpch"))


@query("""SELECT source_id, target_id, arg_min(pattern, (line, ordinal, pattern)) AS pattern, string_agg(DISTINCT pattern, ',' ORDER BY pattern) AS patterns, min(line) AS line FROM (
  SELECT 'tpch.src.' || replace(p_brand, '#', '') AS source_id, p_partkey AS ordinal, f.id AS target_id, CASE WHEN p_type = 'PROMO' THEN 'typeof' ELSE 'keyof typeof' END AS pattern, p_size AS line FROM part JOIN (SELECT DISTINCT name, id FROM defs) f ON f.name = p_name) GROUP BY 1, 2""", TABLES)  # fmt: skip
def typeof_merge(s, d):
    pattern = F.when(F.col("p_type") == "PROMO", "typeof").otherwise("keyof typeof")
    sites = src.table(s, d, "part").select(
        F.concat(F.lit("src/"), F.regexp_replace("p_brand", "#", ""), F.lit(".ts")).alias("path"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("symbol"), pattern.alias("pattern"), F.col("p_size").alias("line"), F.lit("").alias("context")
    )
    return r.typeof_edges(sites, definitions(s, d), "tpch").select("source_id", "target_id", "pattern", F.array_join("patterns", ",").alias("patterns"), "line")


@query("SELECT DISTINCT caller AS source_id, u.id AS target_id FROM held JOIN uniq u ON u.name = callee WHERE caller <> u.id", f"{TABLES}, {HELD}, {IMPORTED} ")
def reference_edges(s, d):
    return r.reference_edges(calls(s, d).withColumnRenamed("callee", "symbol"), definitions(s, d))


ROUTES = [("r0", "/en/:id", "GET"), ("r1", "/:lang/{id}", "*"), ("r2", "/fr/825", "GET"), ("r3", "/de/:id/", "POST"), ("r4", "/a/b/c", "*"), ("r5", "/es/${id}?x=1", "get")]
ROUTE_ROWS = "routes AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{m}', {i})" for i, (a, b, m) in enumerate(ROUTES)) + ") t(route_id, route_path, method, ordinal))"
SEG = "list_transform(list_filter(string_split(regexp_replace({}, '[?#].*$', ''), '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_full_match(x, ':\\w+|\\{{[^}}]+\\}}|\\$\\{{[^}}]+\\}}') THEN '*' ELSE lower(x) END)"


def _routes(s):
    return s.createDataFrame([(a, b, m, i) for i, (a, b, m) in enumerate(ROUTES)], "route_id string, route_path string, method string, ordinal int")


@query("""SELECT page_id AS request_id, arg_min(route_id, (-c, ordinal)) AS route_id, max(c) AS confidence FROM (SELECT page_id, route_id, ordinal,
  CASE WHEN list_bool_and(list_transform(range(1, len(u) + 1), lambda i: u[i] <> '*' AND r[i] <> '*')) THEN 0.95 ELSE 0.80 END::DOUBLE AS c FROM u JOIN r ON len(u) = len(r)
  WHERE upper(method) IN ('*', 'GET') AND list_bool_and(list_transform(range(1, len(u) + 1), lambda i: u[i] = r[i] OR u[i] = '*' OR r[i] = '*'))) GROUP BY 1""",
       f"WITH {ROUTE_ROWS}, u AS (SELECT page_id, {SEG.format('regexp_replace(url, ' + chr(39) + '^https?://[^/]*' + chr(39) + ', ' + chr(39) * 2 + ')')} AS u FROM pages), r AS (SELECT *, {SEG.format('route_path')} AS r FROM routes) ")
def route_match_best(s, d):
    requests = src.table(s, d, "pages").select(F.col("page_id").alias("request_id"), F.regexp_replace("url", "^https?://[^/]*", "").alias("url"), F.lit("get").alias("method"))
    return r.match_routes(requests, _routes(s)).select("request_id", "route_id", "confidence")


GUESSED = [("g0", "/widget/:id", "GET"), ("g1", "/red/ring", "POST"), ("g2", "/bolt", "*"), ("g3", "/hot/gear/{id}", "GET")]


@query("""SELECT request_id, arg_min(route_id, (-c, ordinal)) AS route_id, max(c) AS confidence FROM (SELECT p_partkey AS request_id, route_id, ordinal,
  round(least(0.5, 0.3 + 0.1 * len(list_filter(string_split(route_path, '/'), lambda w: w <> '' AND w NOT LIKE ':%' AND w NOT LIKE '{%' AND contains(p_name, w)))), 6) AS c
  FROM part JOIN routes ON CASE p_type WHEN 'PROMO' THEN method = 'GET' WHEN 'SMALL' THEN method = 'POST' ELSE true END) GROUP BY 1""", "WITH routes AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{m}', {i})" for i, (a, b, m) in enumerate(GUESSED)) + ") t(route_id, route_path, method, ordinal)) ")  # fmt: skip
def route_heuristic(s, d):
    routes = s.createDataFrame([(a, b, m, i) for i, (a, b, m) in enumerate(GUESSED)], "route_id string, route_path string, method string, ordinal int")
    method = F.when(F.col("p_type") == "PROMO", "GET").when(F.col("p_type") == "SMALL", "POST").otherwise("*")
    callers = src.table(s, d, "part").select(F.col("p_partkey").alias("request_id"), F.col("p_name").alias("caller_name"), method.alias("method"))
    return r.guess_routes(callers, routes).select("request_id", "route_id", "confidence")


@query("""SELECT DISTINCT t.id AS source_id, f.id AS target_id FROM (SELECT p_brand AS b, 'tpch.src.' || p_brand || '.test.' || p_name || ' works' AS id, p_name || ' works' AS t FROM part WHERE p_size > 25) t
  JOIN (SELECT p_brand AS b, 'tpch.src.' || p_brand || '.' || p_name AS id, p_name AS n FROM part WHERE p_size <= 25) f ON t.b = f.b AND contains(t.t, f.n)""", "")  # fmt: skip
def test_by_name(s, d):
    test = F.col("p_size") > 25
    rows = src.table(s, d, "part").select(
        F.concat(F.lit("src/"), "p_brand", F.when(test, ".test.ts").otherwise(".ts")).alias("path"), F.col("p_partkey").alias("ordinal"), F.when(test, F.concat("p_name", F.lit(" works"))).otherwise(F.col("p_name")).alias("name"),
        F.when(test, "Test").otherwise("Function").alias("kind"),
    )
    none = s.createDataFrame([], "path string, ordinal long, source string, name string, original string, is_type_only boolean")
    return r.test_edges(r.symbols(rows, "tpch"), none)


FLAGS = """SELECT p_partkey, CASE WHEN p_size = 7 THEN 'main' ELSE p_name END AS name, 'src/' || p_brand || CASE WHEN p_size > 40 THEN '.test.ts' WHEN p_size > 20 THEN '/index.ts' ELSE '.ts' END AS path,
  p_type IN ('PROMO', 'SMALL') AS marked, p_size < 30 AS is_default, p_type = 'LARGE' AS is_exported FROM part"""


@query(f"SELECT p_partkey, name = 'main' OR marked OR path LIKE '%.test.ts' OR (path LIKE '%/index.ts' AND (is_default OR is_exported)) AS entry_point FROM ({FLAGS})", "")
def entry_point_flags(s, d):
    rows = src.table(s, d, "part").select(
        "p_partkey", F.when(F.col("p_size") == 7, "main").otherwise(F.col("p_name")).alias("name"), F.concat(F.lit("src/"), "p_brand", F.when(F.col("p_size") > 40, ".test.ts").when(F.col("p_size") > 20, "/index.ts").otherwise(".ts")).alias("path"),
        F.array(F.when(F.col("p_type") == "PROMO", "Get").when(F.col("p_type") == "SMALL", "route").otherwise("Other")).alias("decorators"), (F.col("p_size") < 30).alias("is_default"), (F.col("p_type") == "LARGE").alias("is_exported"),
    )
    return rows.select("p_partkey", r.entry_point().alias("entry_point"))


@query("""SELECT metric, count(*) AS n, string_agg(path, ',' ORDER BY path) AS files FROM (SELECT path, CASE WHEN bad THEN 'parse_errors' WHEN defs = 0 AND lines > 30 AND calls > 0 AND NOT path LIKE '%.config.ts' THEN 'files_without_symbols' END AS metric FROM (
  SELECT 'd' || doc_id || CASE WHEN lang = 'fr' THEN '.config.ts' ELSE '.ts' END AS path, contains(text, '***') AS bad, CASE WHEN source IS NULL OR lang = 'de' THEN 1 ELSE 0 END AS defs, len(string_split(text, chr(10))) AS lines, len(string_split(text, '@')) - 1 AS calls FROM documents WHERE text IS NOT NULL)) WHERE metric IS NOT NULL GROUP BY 1""", "")  # fmt: skip
def parse_anomalies(s, d):
    rows = src.table(s, d, "documents").where("text IS NOT NULL").select(
        F.concat(F.lit("d"), "doc_id", F.when(F.col("lang") == "fr", ".config.ts").otherwise(".ts")).alias("path"), F.size(F.split("text", "\n")).alias("line_count"), F.col("text").contains("***").alias("has_error"),
        F.when(F.col("source").isNull() | F.coalesce(F.col("lang") == "de", F.lit(False)), 1).otherwise(0).alias("definitions"), F.lit(0).alias("exports"), F.lit(0).alias("imports"), (F.size(F.split("text", "@")) - 1).alias("calls"),
    )
    return r.parse_anomalies(rows).select("metric", "n", F.array_join("files", ",").alias("files"))


@query("""SELECT DISTINCT array_to_string(p[1:i], '/') AS path FROM (SELECT string_split(regexp_replace(url, '^https?://', ''), '/') AS p FROM pages), unnest(range(1, len(p))) t(i)""", "")
def folder_expansion(s, d):
    return r.folders(src.table(s, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")), "web")[0].select("path")


@query("SELECT CASE WHEN i = 1 THEN 'web' ELSE 'web.folder.' || array_to_string(p[1:i - 1], '/') END AS source_id, 'web.folder.' || array_to_string(p[1:i], '/') AS target_id FROM (SELECT DISTINCT p[1:i] AS p, i FROM (SELECT string_split(regexp_replace(url, '^https?://', ''), '/') AS p FROM pages), unnest(range(1, len(p))) t(i))", "")
def folder_edges(s, d):
    return r.folders(src.table(s, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")), "web")[1].where("type = 'CONTAINS_FOLDER'").select("source_id", "target_id")


@query("""SELECT 'p' || a.f AS file_a, 'p' || b.f AS file_b, count(*) AS count FROM files a JOIN files b ON a.c = b.c AND 'p' || a.f < 'p' || b.f GROUP BY 1, 2 HAVING count(*) >= 3""",
       "WITH t AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS f FROM lineitem), files AS (SELECT * FROM t WHERE c IN (SELECT c FROM t GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20)) ")
def cochange_pairs(s, d):
    return g.co_changes(src.table(s, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.concat(F.lit("p"), "l_partkey").alias("file")))
