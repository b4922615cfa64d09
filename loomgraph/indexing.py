"""From source files to a graph: structure, definitions, imports, calls, heritage, routes, tests, typeof and co-changes."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.model import EDGES, HASHES, NODES, PROJECTS, Graph, complete
from loomgraph.operators import graph as g
from loomgraph.operators import resolve as r
from loomgraph.operators import store
from loomgraph.operators.paths import saved
from loomgraph.sources import extract as x
from loomgraph.sources import files as fs


@dataclass(frozen=True)
class Indexed:
    graph: Graph
    parsed: DataFrame
    stats: dict


def _json(**columns):
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]))


def build(files: DataFrame, parsed: DataFrame, project: str, commits: DataFrame | None = None, now_ms: int = 0, root: str = "") -> Graph:
    """The graph of hashed ``files`` and their ``parsed`` rows."""
    spark = files.sparkSession
    paths = files.select(F.col("rel_path").alias("path"))
    flat = {k: x.flat(parsed, k) for k in ("definitions", "imports", "calls", "routes", "typeof_sites")}
    defs = saved(r.symbols(flat["definitions"], project))
    folders, contains = r.folders(paths, project)
    sizes = files.join(parsed.select(F.col("path").alias("rel_path"), "line_count"), "rel_path", "left")
    qn = r.file_qn(project, F.col("rel_path"))
    node = lambda df, **c: complete(df.select(*[v.alias(k) for k, v in c.items()]), NODES)
    nodes = [node(spark.range(1), id=F.lit(project), project=F.lit(project), label=F.lit("Project"), name=F.lit(project), qualified_name=F.lit(project), props=_json(name=F.lit(project), root_path=F.lit(root)))]
    nodes.append(node(folders, id=F.col("id"), project=F.lit(project), label=F.lit("Folder"), name=F.col("name"), qualified_name=F.col("id"), file_path=F.lit(None), props=_json(name=F.col("name"), path=F.col("path"))))
    file_props = _json(name=F.element_at(F.split("rel_path", "/"), -1), path=F.col("rel_path"), language=F.col("language"), line_count=F.col("line_count"), size_bytes=F.col("size"), content_hash=F.col("content_hash"))
    nodes.append(node(sizes, id=qn, project=F.lit(project), label=F.lit("File"), name=F.element_at(F.split("rel_path", "/"), -1), qualified_name=qn, file_path=F.col("rel_path"), props=file_props))
    entry = F.when(F.col("kind").isin("Function", "Method"), r.entry_point())
    symbol_props = _json(**{k: F.col(k) for k in ("name", "is_exported", "signature", "return_type", "is_async", "is_static", "is_abstract", "decorators", "receiver")}, is_entry_point=entry)
    named = store.first_by(defs.withColumn("_o", -F.col("ordinal")), ["id"], ["_o"])  # of equal ids the last in the file stays
    nodes.append(node(named, id=F.col("id"), project=F.lit(project), label=F.col("kind"), name=F.col("name"), qualified_name=F.col("id"), file_path=F.col("path"), start_line=F.col("start_line"), end_line=F.col("end_line"), props=symbol_props))
    route_id = F.concat(r.file_qn(project, F.col("path")), F.lit(".__route_"), F.col("method"), F.lit("_"), F.regexp_replace("route_path", "[^a-zA-Z0-9]", "_"))
    routes = saved(flat["routes"].withColumn("route_id", route_id))
    one_route = routes.groupBy("route_id").agg(F.min(F.struct("path", "ordinal", "line", "method", "route_path", "handler")).alias("f")).select("route_id", "f.*")
    nodes.append(node(one_route, id=F.col("route_id"), project=F.lit(project), label=F.lit("Route"), name=F.concat_ws(" ", "method", "route_path"), qualified_name=F.col("route_id"), file_path=F.col("path"), start_line=F.col("line"), props=_json(name=F.concat_ws(" ", "method", "route_path"), method=F.col("method"), path=F.col("route_path"), handler=F.col("handler"))))
    imports, packages = r.import_edges(flat["imports"], paths, project)
    nodes.append(node(packages, id=F.col("id"), project=F.lit(project), label=F.lit("Package"), name=F.col("name"), qualified_name=F.col("id"), props=_json(name=F.col("name"))))
    all_nodes = saved(reduce(DataFrame.unionByName, nodes).dropDuplicates(["id"]))
    edge = lambda df, props=F.lit("{}"), confidence=F.lit(1.0): complete(df.select("source_id", "target_id", "type", props.alias("props"), confidence.alias("confidence"), F.lit(project).alias("project")), EDGES)
    edges = [edge(contains), edge(imports)]
    edges.append(edge(defs.where("kind <> 'Method'").select(F.col("file_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("DEFINES").alias("type"))))
    owners = defs.where("kind IN ('Class', 'Interface')").select("path", F.col("name").alias("receiver"), F.col("id").alias("source_id")).distinct()
    edges.append(edge(defs.where("kind = 'Method'").select("path", "receiver", F.col("id").alias("target_id"), F.lit("DEFINES_METHOD").alias("type")).join(owners, ["path", "receiver"])))
    edges.append(edge(r.heritage(defs)))
    calls = r.resolve_calls(flat["calls"], flat["imports"], defs)
    edges.append(edge(calls, _json(resolution_method=F.col("resolution_method")), F.col("confidence")))
    handlers = one_route.where("handler IS NOT NULL").select("path", F.col("handler").alias("name"), F.col("route_id").alias("source_id")).join(defs.select("path", "name", F.col("id").alias("target_id")).distinct(), ["path", "name"])
    edges.append(edge(handlers.withColumn("type", F.lit("HANDLES"))))
    requests = r.enclosing(flat["calls"].where("http_method IS NOT NULL"), defs).withColumn("request_id", F.concat_ws("#", "path", "ordinal")).withColumnRenamed("http_method", "method")
    targets = one_route.select("route_id", "route_path", "method", F.col("ordinal"))
    hits = r.match_routes(requests.where("url IS NOT NULL"), targets).unionByName(r.guess_routes(requests.where("url IS NULL"), targets))
    http = requests.select("request_id", F.col("caller").alias("source_id"), "url", "method", "ordinal").join(hits, "request_id")
    http = http.groupBy("source_id", F.col("route_id").alias("target_id")).agg(F.min(F.struct("ordinal", "url", "method", "confidence", "resolution_method")).alias("f")).select("source_id", "target_id", "f.*", F.lit("HTTP_CALLS").alias("type"))
    edges.append(edge(http, _json(confidence=F.col("confidence"), url_path=F.col("url"), http_method=F.col("method"), resolution_method=F.col("resolution_method"))))
    edges.append(edge(r.test_edges(defs, flat["imports"]).withColumn("type", F.lit("TESTS"))))
    typeof = r.typeof_edges(flat["typeof_sites"], defs, project).withColumn("type", F.lit("TYPEOF_REFERENCES"))
    edges.append(edge(typeof, _json(pattern=F.col("pattern"), patterns=F.col("patterns"), line=F.col("line"), context=F.col("context"))))
    if commits is not None:
        pairs = g.co_changes(commits.join(paths.withColumnRenamed("path", "file"), "file", "left_semi"))
        pairs = pairs.select(r.file_qn(project, F.col("file_a")).alias("source_id"), r.file_qn(project, F.col("file_b")).alias("target_id"), "count", F.lit("FILE_CHANGES_WITH").alias("type"))
        edges.append(edge(pairs, _json(count=F.col("count"))))
    ranked = [e.withColumn("_pass", F.lit(i)) for i, e in enumerate(edges)]
    rows = store.referential(reduce(DataFrame.unionByName, ranked), all_nodes)
    none = spark.createDataFrame([], EDGES)
    all_edges = saved(store.last_wins(none, rows, ["source_id", "target_id", "type"], "_pass"))
    hashes = complete(files.withColumn("project", F.lit(project)), HASHES)
    projects = complete(spark.createDataFrame([(project, root, now_ms, all_nodes.count(), all_edges.count(), now_ms)], PROJECTS), PROJECTS)
    return Graph(all_nodes, all_edges, projects, hashes)


def index(files: DataFrame, project: str, previous: Indexed | None = None, commits: DataFrame | None = None, now_ms: int = 0, root: str = "") -> Indexed:
    """Index hashed ``files`` (see ``sources.files.hashed``). With ``previous`` only changed files are parsed again.

    Edges are resolved from the extraction rows of all files, so edges into changed files are right as well.
    """
    if previous is None:
        parsed, changed = saved(x.extract(files)), files.count()
    else:
        states = store.classify(files, previous.graph.hashes).where("state <> 'unchanged'").select(F.col("path").alias("rel_path"))
        fresh = files.join(states, "rel_path", "left_semi")
        kept = previous.parsed.join(files.select(F.col("rel_path").alias("path")), "path", "left_semi").join(states.withColumnRenamed("rel_path", "path"), "path", "left_anti")
        changed = fresh.count()
        parsed = saved(x.extract(fresh).unionByName(kept)) if changed else previous.parsed.join(files.select(F.col("rel_path").alias("path")), "path", "left_semi")
    graph = build(files, parsed, project, commits, now_ms, root)
    return Indexed(graph, parsed, {"changed": changed, "nodes": graph.projects.first()["node_count"], "edges": graph.projects.first()["edge_count"]})


def anomalies(parsed: DataFrame) -> DataFrame:
    counts = {k: F.size(k).alias(k) for k in ("definitions", "exports", "imports", "calls")}
    return r.parse_anomalies(parsed.select("path", "line_count", "has_error", *counts.values()))


def index_repository(spark, root: str, project: str | None = None, previous: Indexed | None = None, now_ms: int = 0) -> Indexed:
    """Discover, hash, parse and index a folder, with its git history where there is one."""
    files = saved(fs.hashed(fs.discover(spark, root)))
    return index(files, project or store.project_name(root), previous, fs.git_history(spark, root), now_ms, root)
