"""Files, extraction, indexing, the tools, snapshots and the change feed on a small repository."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.model import EDGES, HASHES, NODES, PROJECTS, Graph, complete
from loomgraph.operators import paths, rank, resolve, search, store
from loomgraph.sources import extract, files
from loomgraph.streaming import feed
from loomgraph.tools import Tools

SOURCES = {
    "src/app.ts": """import { helper as h, Base } from './util';
import express from 'express';
// import { no } from './no';
const app = express();
export class Widget extends Base implements Thing {
  async render(x: number): Promise<void> {
    await h(x);
    this.draw();
  }
  draw() { return fetch('/users/7', { method: 'get' }); }
}
export interface Thing { a: string }
export const main = () => { const w = new Widget(); w.render(1); };
type R = ReturnType<typeof main>; // typeof helper
app.get('/users/:id', main);
""",
    "src/util.ts": "export function helper(x) { return 'call()'; }\nexport class Base {}\n",
    "src/util.test.ts": "import { helper } from './util';\ndescribe('util', () => { it('helper works', () => { helper(1); }); });\n",
    "src/api/svc.py": "import os\nfrom .x import y as z\nclass A(B):\n    def go(self):\n        return helper2()\ndef helper2():\n    return requests.get('/users/3')\n@app.get('/items/{id}')\nasync def items(): await helper2()\n",
    "src/bad.py": "def broken(:\n",
    "main.go": 'package main\nimport "fmt"\ntype T struct {}\nfunc (t *T) Run() { fmt.Println("x") }\nfunc main() { t := T{}; t.Run() }\n',
    "node_modules/x.js": "function gone() {}\n",
    "skip/me.ts": "export function skipped() {}\n",
    ".gitignore": "# comment\nskip/\n*.log\n",
}


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo") / "Demo_App"
    for name, text in SOURCES.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    t = Tools(spark)
    assert not t.call("index_repository", repo_path=str(root))["is_error"]
    return t


def edges(t, kind):
    cut = lambda c: F.regexp_replace(c, r"^demo-app\.(src\.)?", "")
    return {tuple(r) for r in t.graph.edges.where(F.col("type") == kind).select(cut("source_id"), cut("target_id")).collect()}


def test_graph_of_a_repository(tools):
    assert {r[0] for r in tools.graph.nodes.where("label = 'File'").select("file_path").collect()} == {"src/app.ts", "src/util.ts", "src/util.test.ts", "src/api/svc.py", "src/bad.py", "main.go"}
    assert edges(tools, "CALLS") == {("app.main", "app.Widget"), ("app.main", "app.render"), ("app.render", "app.draw"), ("api.svc.go", "api.svc.helper2"), ("main.main", "main.Run")}
    assert edges(tools, "ASYNC_CALLS") == {("app.render", "util.helper"), ("api.svc.items", "api.svc.helper2")}
    assert edges(tools, "EXTENDS") == {("app.Widget", "util.Base")} and edges(tools, "IMPLEMENTS") == {("app.Widget", "app.Thing")}
    assert edges(tools, "HTTP_CALLS") == {("app.draw", "app.__route_GET__users__id"), ("api.svc.helper2", "app.__route_GET__users__id")}
    assert edges(tools, "TESTS") == {("util.test.util>helper works", "util.helper")}
    assert edges(tools, "TYPEOF_REFERENCES") == {("app", "app.main"), ("app", "main.main")}  # every symbol of the name
    assert edges(tools, "IMPORTS") >= {("app", "util"), ("util.test", "util"), ("app", "__pkg_express"), ("main", "__pkg_fmt")}
    assert edges(tools, "HANDLES") == {("app.__route_GET__users__id", "app.main"), ("api.svc.__route_GET__items__id_", "api.svc.items")}
    assert edges(tools, "DEFINES_METHOD") >= {("app.Widget", "app.render"), ("api.svc.A", "api.svc.go")}
    status = tools.call("index_status")["structured"]
    assert status["anomalies"] == [{"metric": "parse_errors", "n": 1, "files": ["src/bad.py"]}]


def test_tools(spark, tools):
    ok = lambda name, **a: tools.call(name, **a)["structured"]
    assert ok("ping") == "pong" and ok("list_projects")[0]["name"] == "demo-app"
    assert ok("search_graph", query="helper")["rows"][0]["rank"] == 0
    assert {r["name"] for r in ok("search_graph", label="Class", max_degree=99)["rows"]} == {"Widget", "Base", "A", "T"}
    assert ok("get_code_snippet", symbol="helper")["snippet"].startswith("export function helper")
    assert tools.call("get_code_snippet", symbol="nothing")["is_error"]
    assert {n["node_id"].rsplit(".", 1)[1]: n["depth"] for n in ok("trace_call_path", symbol="HELPER", direction="callers")["nodes"]} == {"render": 1, "main": 2}
    hit = ok("detect_changes", changes=spark.createDataFrame([("src/util.ts", "modified")], "path string, status string"))
    assert [c["node_id"] for c in hit["callers"]][0].endswith("render") and {s["risk"] for s in hit["summary"]} == set(paths.LEVELS)
    assert ok("query_graph", query="MATCH (n:Class) RETURN COUNT(*) AS n")["rows"] == [(4,)]
    assert tools.call("query_graph", query="DROP (n)")["is_error"]
    assert ok("search_code", pattern="helper", file_pattern="src/*.py")["total"] == 0
    assert [r["line_no"] for r in ok("search_code", pattern="HELPER2(", file_pattern="**/*.py")["results"]] == [5, 6, 9]
    ok("manage_adr", mode="store", project="p", content=json.dumps({"STACK": "spark"}))
    assert ok("manage_adr", mode="update", project="p", sections={"PURPOSE": "x"})["summary"] == {"STACK": "spark", "PURPOSE": "x"}
    assert tools.call("manage_adr", mode="update", project="p", sections={"BAD": "x"})["is_error"]
    assert ok("manage_adr") == ["p"] and ok("manage_adr", mode="delete", project="p") and ok("manage_adr") == []
    text = json.dumps([{"fromId": "demo-app.src.util.helper", "toId": "demo-app.src.app.main", "type": "USAGE", "weight": 2}, {"fromId": 1}, {"fromId": "x", "toId": "y", "type": "z"}])
    assert ok("ingest_traces", traces=text) == {"ingested": 1, "skipped": 1}
    assert ok("find_typeof_references", symbol="main")[0]["pattern"] == "ReturnType<typeof>"
    assert {"labels", "types", "patterns"} <= set(ok("get_graph_schema")) and ok("get_architecture", aspects=["languages"])["languages"][0] == {"language": "typescript", "n": 3}
    assert tools.call("no_such_tool")["is_error"] and tools.call("search_graph", direction="up", label="x")["is_error"]


def test_incremental_index_parses_only_changes(spark, tools):
    from loomgraph import indexing

    changed = files.hashed(files.discover(spark, tools.root))
    edited = changed.withColumn("text", F.when(F.col("rel_path") == "src/util.ts", F.lit("export function helper(x) { return other(x); }\nexport function other(x) {}\nexport class Base {}\n")).otherwise(F.col("text")))
    edited = edited.withColumn("content_hash", F.sha2("text", 256)).withColumn("mtime_ns", F.col("mtime_ns") + 1)
    again = indexing.index(edited, "demo-app", tools.indexed)
    assert again.stats["changed"] == 1
    t = Tools(spark, again.graph)
    assert ("util.helper", "util.other") in edges(t, "CALLS") and ("app.render", "util.helper") in edges(t, "ASYNC_CALLS")


def test_extraction_details():
    ts = extract.parse_file("a.ts", SOURCES["src/app.ts"], "typescript")
    assert [(i["name"], i["original"]) for i in ts["imports"]] == [("h", "helper"), ("Base", None), ("express", "default")]
    assert {(d["name"], d["kind"], d["start_line"], d["end_line"]) for d in ts["definitions"]} >= {("Widget", "Class", 5, 11), ("render", "Method", 6, 9), ("main", "Function", 13, 13), ("R", "Type", 14, 14)}
    assert [s["symbol"] for s in ts["typeof_sites"]] == ["main", "main"]
    py = extract.parse_file("a.py", SOURCES["src/api/svc.py"], "python")
    assert py["routes"] == [{"method": "GET", "route_path": "/items/{id}", "handler": "items", "line": 8}]
    assert extract.parse_file("a.xyz", "x", None) is None
    for lang, text, name in [("rust", "pub fn run() {}\nuse a::b;", "run"), ("java", "public class A {\n  public int go(int x) { return 1; }\n}", "go"), ("c", "int f(int a) { return a; }", "f"), ("ruby", "class A\n  def go\n  end\nend", "go"), ("php", "<?php\nfunction f($a) { }", "f")]:
        assert name in {d["name"] for d in extract.parse_file("x", text, lang)["definitions"]}


def test_ignore_patterns():
    import re

    p = re.compile(files.ignore_regex(["*.log", "/top", "dir/", "!keep", "# no"]))
    assert all(p.match(x) for x in ("a.log", "x/a.log", "top", "dir/a", "x/dir/a")) and not any(p.match(x) for x in ("x/top", "a.logs", "keep"))
    assert files.ignore_regex([]) is None


def chain(spark):
    ids = ["a", "b", "c", "d"]
    n = complete(spark.createDataFrame([(i, i, "p", "Function", f"{i}.ts") for i in ids], "id string, name string, project string, label string, file_path string"), NODES)
    e = complete(spark.createDataFrame([("a", "b", "CALLS", 1.0), ("b", "c", "CALLS", 0.4), ("c", "d", "CALLS", 1.0), ("d", "a", "CALLS", 1.0), ("a", "a", "CALLS", 1.0)], "source_id string, target_id string, type string, confidence double"), EDGES)
    return Graph(n, e, spark.createDataFrame([], PROJECTS), spark.createDataFrame([], HASHES))


def test_walks(spark):
    g = chain(spark)
    start = spark.createDataFrame([("a",)], "id string")
    got = {r["node_id"]: (r["depth"], r["path"]) for r in paths.bfs_paths(g, start, ["CALLS"], False, 5).collect()}
    assert got == {"b": (1, ["a", "b"]), "c": (2, ["a", "b", "c"]), "d": (3, ["a", "b", "c", "d"])}
    assert {r["node_id"] for r in paths.bfs_paths(g, start, ["CALLS"], False, 5, min_confidence=0.5).collect()} == {"b"}
    assert paths.bfs_paths(g, start, [], False, 5).count() == 0
    assert {r["id"]: r["degree"] for r in search.degrees(g.nodes, g.edges).collect()} == {"a": 3, "b": 2, "c": 2, "d": 2}
    assert [tuple(r) for r in paths.call_path(g, "a", "d").collect()] == [(3, "a>b>c>d")]
    assert paths.trace(g, "nobody") is None


def test_pagerank_follows_its_definition(spark):
    ids = [f"n{i}" for i in range(20)]
    links = [(i, (i + k) % 20) for i in range(19) for k in (1, 2, 3)] + [(0, 1)]
    score, n = [1 / 20] * 20, 20
    tele = [0.5 if i == 0 else 1 / n for i in range(n)]
    tele[10] = 0.5
    for _ in range(12):
        new = [0.15 * t for t in tele]
        for i in range(n):
            out = [b for a, b in links if a == i]
            for b in out:
                new[b] += 0.85 * 0.9 * score[i] / len(out)
            if not out:
                new[i] += 0.85 * 0.1 * score[i]
        score = new
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    e = spark.createDataFrame([(ids[a], ids[b]) for a, b in links] + [("n0", "unknown")], "source_id string, target_id string")
    seeds = spark.createDataFrame([("n0", 2.0), ("n10", 2.0), ("zz", 9.0)], "id string, weight double")
    got = {r["id"]: r["score"] for r in rank.pagerank(nodes, e, seeds, rounds=12, epsilon=0).collect()}
    assert all(abs(got[ids[i]] - score[i]) < 1e-12 for i in range(n))
    assert rank.normalise(rank.pagerank(nodes, e, rounds=3)).agg(F.max("score")).first()[0] == 1.0


def test_snapshots(spark, tmp_path):
    g = chain(spark)
    at = store.Snapshots(spark, f"file://{tmp_path}/s")
    assert at.version() is None
    first = at.write(g)
    at.write(store.delete_nodes(at.read(), ids=spark.createDataFrame([("b",)], "id string")))
    assert at.version() != first and at.read().nodes.count() == 3
    assert {(r.source_id, r.target_id) for r in at.read().edges.collect()} == {("c", "d"), ("d", "a"), ("a", "a")}
    with pytest.raises(ValueError):
        store.upsert_edges(g, spark.createDataFrame([("a", "zz", "X")], "source_id string, target_id string, type string"), strict=True)
    touched = store.touch_project(store.upsert_projects(g, spark.createDataFrame([("p", "/r")], "name string, root_path string")), "p", 5)
    assert store.upsert_projects(touched, spark.createDataFrame([("p", "/q")], "name string, root_path string")).projects.select("root_path", "last_opened_at").first() == ("/q", 5)
    assert store.project_name("/x/My App_1/") == "my-app-1"


def test_alias_closure(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "name string, target string")
    assert {tuple(r) for r in resolve.alias_closure(e).collect()} == {("a", "d"), ("b", "d"), ("c", "d")}


def test_change_feed_streams(spark, tmp_path):
    """Bursts drain once, updates see the changed files, and late events are dropped."""
    folder = tmp_path / "events"
    folder.mkdir()
    put = lambda name, rows: (folder / name).write_text("\n".join(json.dumps(dict(zip(("path", "kind", "ts"), r))) for r in rows))
    put("1.json", [("a", "change", "2024-01-01T00:00:00.000"), ("a", "change", "2024-01-01T00:00:00.200"), ("b", "change", "2024-01-01T00:00:01.000"), ("a", "change", "2024-01-01T00:10:00.000")])
    events = feed.read_events(spark, str(folder))
    q = feed.debounce(events).writeStream.format("memory").queryName("drained").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.path, r.n_events) for r in spark.table("drained").collect()) == [("a", 2), ("b", 1)]
    batch = spark.read.schema(feed.EVENTS).json(str(folder))
    assert [r.paths for r in feed.settle(feed.debounce(batch)).orderBy("start_ts").collect()] == [["a", "b"], ["a"]]
    schema = "rel_path string, content_hash string, mtime_ns long, size long"
    now, then, seen = spark.createDataFrame([("a", "h2", 2, 1), ("c", "h", 9, 9)], schema), spark.createDataFrame([("a", "h1", 1, 1), ("b", "h", 1, 1)], schema), []
    run = feed.start(events, lambda: now, lambda: then, lambda states: seen.extend(map(tuple, states.collect())), str(tmp_path / "c2"), available_now=True)
    run.awaitTermination()
    assert sorted(seen) == [("a", "changed"), ("b", "deleted")]
    assert (feed.guard("search_graph", 0, "s", None, 99), feed.guard("search_graph", 5, "s2", "s", 99), feed.guard("ping", 0, "s", None, 99), feed.guard("x", 5, "s2", "s", 3)) == ("full", "incremental", None, None)
    assert [feed.sweep_seconds(n) for n in (1, 3000, 9000, 50000)] == [60, 120, 300, 600]
