"""The tool interface: sixteen calls over one set of snapshots. Results are plain values; tables come as lists of dicts."""

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import indexing
from loomgraph.functions import shorten
from loomgraph.lang.cypher import cypher_page
from loomgraph.model import Graph, empty
from loomgraph.operators import paths, search, store
from loomgraph.sources import files as fs

DIRECTIONS = {"inbound": "inbound", "outbound": "outbound", "both": "both", "callers": "inbound", "callees": "outbound"}
MOST_TEXT = 8000


def text_of(value) -> str:
    """A result as text, cut at 8 000 characters with a notice."""
    out = value if isinstance(value, str) else json.dumps(value, default=str, indent=1)
    return out if len(out) <= MOST_TEXT else out[:MOST_TEXT] + "\n… (truncated)"


def envelope(value, error: bool = False) -> dict:
    return {"text": text_of(value), "structured": None if error else value, "is_error": error}


def required(args: dict, name: str) -> str:
    value = args.get(name)
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be a text")
    return value


def one_of(args: dict, name: str, allowed, default):
    value = args.get(name, default)
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(map(str, allowed))}")
    return value


def rows(df: DataFrame) -> list[dict]:
    """The rows of a bounded result."""
    return [r.asDict(recursive=True) for r in df.collect()]


class Tools:
    def __init__(self, spark: SparkSession, graph: Graph | None = None, root: str | None = None, files: DataFrame | None = None):
        self.spark, self.graph, self.root, self.files = spark, graph or empty(spark), root, files
        self.indexed, self.records = None, {}

    def call(self, tool: str, **args) -> dict:
        """Run a tool by name; errors come back in the envelope."""
        try:
            if tool.startswith("_") or tool == "call" or not callable(getattr(type(self), tool, None)):
                raise ValueError(f"unknown tool {tool}")
            return envelope(getattr(self, tool)(**args))
        except ValueError as e:
            return envelope(str(e), error=True)

    def ping(self):
        return "pong"

    def index_repository(self, repo_path: str | None = None):
        root = repo_path or self.root
        if not root:
            raise ValueError("repo_path must be a text")
        self.indexed = indexing.index_repository(self.spark, root, previous=self.indexed if root == self.root else None, now_ms=int(time.time() * 1000))
        self.root, self.graph = root, self.indexed.graph
        self.files = None
        return self.indexed.stats

    def list_projects(self):
        return rows(search.projects(self.graph))

    def delete_project(self, project_name: str):
        if self.graph.projects.where(F.col("name") == project_name).isEmpty():
            raise ValueError(f"no project {project_name}")
        report = store.prune_report(self.graph, project_name)
        self.graph = store.delete_project(self.graph, project_name)
        return report

    def index_status(self, project: str | None = None):
        g = self.graph if project is None else self.graph.with_(nodes=self.graph.nodes.where(F.col("project") == project), edges=self.graph.edges.where(F.col("project") == project))
        out = {"labels": rows(search.label_counts(g.nodes).orderBy("label")), "types": rows(search.type_counts(g.edges).orderBy("type")), "totals": rows(search.totals(g))[0]}
        if self.indexed:
            out["anomalies"] = rows(indexing.anomalies(self.indexed.parsed))
        return out

    def search_graph(
        self, query=None, label=None, project=None, file_pattern=None, relationship=None, direction="both", min_degree=None, max_degree=None, exclude_entry_points=False, case_sensitive=False, limit=20, offset=0
    ):
        if query and not any((label, project, file_pattern, relationship, min_degree is not None, max_degree is not None, exclude_entry_points, case_sensitive, offset)):
            found = search.rank_headings(search.search_ranked(self.graph.nodes, query)).orderBy("rank", "name", "id").limit(limit)
            return {"rows": rows(found.drop("props"))}
        types = relationship.split("|") if isinstance(relationship, str) else relationship
        found = search.search_nodes(self.graph, query, label, project, file_pattern, types, DIRECTIONS[one_of({"direction": direction}, "direction", DIRECTIONS, "both")], min_degree, max_degree, exclude_entry_points, case_sensitive)
        page, total, more = search.page(found, limit, offset)
        return {"rows": rows(page.drop("props")), "total": total, "has_more": more}

    def get_graph_schema(self):
        return {k: rows(v) for k, v in search.graph_schema(self.graph).items()}

    def get_architecture(self, aspects=("all",)):
        out = {k: rows(v) for k, v in search.architecture(self.graph, aspects).items()}
        if self.records and ("all" in aspects or "adr" in aspects):
            out["adr"] = self.records
        return out

    def _texts(self) -> DataFrame:
        if self.files is None:
            if not self.root:
                raise ValueError("no repository is indexed")
            self.files = paths.saved(fs.hashed(fs.discover(self.spark, self.root)).select(F.col("rel_path").alias("path"), "text"))
        return self.files

    def search_code(self, pattern: str, file_pattern=None, regex=False, case_sensitive=False, max_results=50, offset=0):
        found = search.search_code(self._texts(), required({"pattern": pattern}, "pattern"), file_pattern, regex, case_sensitive)
        total = found.count()
        return {"results": rows(found.orderBy("path", "line_no").offset(offset).limit(max_results)), "total": total, "has_more": offset + max_results < total}

    def get_code_snippet(self, symbol: str):
        found, several = search.symbol_for_snippet(self.graph, required({"symbol": symbol}, "symbol"))
        if found is None:
            raise ValueError(f"{symbol} is ambiguous: {', '.join(several)}" if several else f"no symbol {symbol}")
        got = search.snippets(self.graph.nodes.where(F.col("id") == found), self._texts()).select("id", shorten(F.col("snippet")).alias("snippet"))
        return rows(got)[0] if not got.isEmpty() else {"id": found, "snippet": None}

    def trace_call_path(self, symbol: str, direction="both", depth=3, risk_labels=False, min_confidence=0.0):
        side = DIRECTIONS[one_of({"direction": direction}, "direction", DIRECTIONS, "both")]
        got = paths.trace(self.graph, required({"symbol": symbol}, "symbol"), side, depth, risk_labels, min_confidence)
        if got is None:
            return {"nodes": [], "edges": [], "start": None, "truncated": False}
        nodes, edges, truncated = got
        out = {"nodes": rows(nodes.orderBy("depth", "node_id")), "edges": rows(edges.orderBy("source_id", "target_id")), "levels": rows(paths.by_depth(nodes).orderBy("depth")), "truncated": truncated}
        return {**out, "summary": rows(paths.risk_summary(nodes))} if risk_labels else out

    def detect_changes(self, scope="all", base_branch="main", depth=3, min_confidence=0.0, changes: DataFrame | None = None):
        one_of({"scope": scope}, "scope", ["unstaged", "staged", "all", "branch"], "all")
        changed = changes if changes is not None else fs.git_changes(self.spark, self.root or ".", scope, base_branch)
        hit = paths.saved(paths.impact(self.graph, changed, depth, min_confidence))
        return {"files": rows(changed), "symbols": rows(paths.changed_symbols(self.graph, changed).select("id", "label", "file_path")), "callers": rows(hit.orderBy("depth", "node_id")), "summary": rows(paths.risk_summary(hit))}

    def query_graph(self, query: str, limit=None, offset=0):
        page = cypher_page(self.graph, required({"query": query}, "query"), None, limit, offset)
        return {"columns": page.columns, "rows": page.rows, "total": page.total, "truncated": page.truncated}

    def manage_adr(self, mode="list", project=None, content=None, sections=None):
        one_of({"mode": mode}, "mode", ["list", "get", "store", "update", "delete"], "list")
        if mode == "list":
            return sorted(self.records)
        name = required({"project": project}, "project")
        if mode == "get":
            return self.records.get(name)
        if mode == "delete":
            return self.records.pop(name, None) is not None
        given = json.loads(content) if mode == "store" and isinstance(content, str) else content if mode == "store" else sections
        if not isinstance(given, dict):
            raise ValueError("sections must be given")
        now = int(time.time() * 1000)
        old = self.records.get(name, {"created_at": now, "summary": {}})
        merged = store.merge_adr(old["summary"] if mode == "update" else None, given)
        self.records[name] = {"created_at": old["created_at"], "updated_at": now, "summary": merged}
        return self.records[name]

    def ingest_traces(self, traces: str):
        new = fs.parse_traces(self.spark, required({"traces": traces}, "traces"))
        props = F.when(F.col("weight").isNotNull(), F.to_json(F.struct("weight"))).otherwise("{}")
        project = self.graph.nodes.select(F.col("id").alias("source_id"), "project")
        edges = new.join(project, "source_id").select("project", "source_id", "target_id", "type", props.alias("props"))
        before = paths.saved(store.referential(edges, self.graph.nodes))
        self.graph = store.upsert_edges(self.graph, before)
        return {"ingested": before.count(), "skipped": new.count() - before.count()}

    def find_typeof_references(self, symbol: str, project_name: str | None = None):
        g = self.graph if project_name is None else self.graph.with_(nodes=self.graph.nodes.where(F.col("project") == project_name))
        return rows(search.typeof_references(g, required({"symbol": symbol}, "symbol")))
