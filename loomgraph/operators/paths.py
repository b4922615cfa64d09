"""Walks: simple paths, breadth-first levels, callers, traces, risk and impact.

Loops write each level to the checkpoint folder (``spark.checkpoint.dir``, a local one in local mode), so plans stay short
and a lost executor repeats one level only. Edges are reduced to distinct pairs and written once, partitioned by the end
that the walk joins on.
"""

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.model import Graph, prop_number

CALL_TYPES = ["CALLS", "HTTP_CALLS", "ASYNC_CALLS"]
RISK_TYPES = ["CALLS", "ASYNC_CALLS"]
MOST_ROWS = 200
LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def saved(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            at = tempfile.mkdtemp(prefix="loomgraph-")
        context.setCheckpointDir(at)
    return df.checkpoint()


def steps(edges: DataFrame, inbound: bool) -> DataFrame:
    here, there = ("target_id", "source_id") if inbound else ("source_id", "target_id")
    return edges.select(F.col(here).alias("_at"), F.col(there).alias("_to")).distinct()


def simple_paths(starts: DataFrame, edges: DataFrame, low: int, high: int, inbound: bool = False) -> DataFrame:
    """start_id, node_id, depth, path: one row per simple path of ``low`` to ``high`` hops from every id of ``starts``."""
    step = saved(steps(edges, inbound))
    level = starts.select(F.col("id").alias("start_id"), F.col("id").alias("node_id"), F.lit(0).cast("long").alias("depth"), F.array("id").alias("path"))
    found = level if low == 0 else None
    for depth in range(1, high + 1):
        level = level.join(step, F.col("node_id") == F.col("_at")).where(~F.array_contains("path", F.col("_to")))
        level = level.select("start_id", F.col("_to").alias("node_id"), F.lit(depth).cast("long").alias("depth"), F.concat("path", F.array("_to")).alias("path"))
        if depth < high:
            level = saved(level)
        if depth >= low:
            found = level if found is None else found.unionByName(level)
    return found if found is not None else level.where("false")


def bfs_paths(graph: Graph, starts: DataFrame, types: list[str], inbound: bool, max_depth: int, max_rows: int | None = MOST_ROWS, min_confidence: float = 0.0) -> DataFrame:
    """Every simple path from the starts, start left out; per start the first ``max_rows`` by depth, then path."""
    e = graph.edges.where(F.col("type").isin(types)) if types else graph.edges.where("false")
    e = e.where(F.col("confidence") >= min_confidence) if min_confidence > 0 else e
    found = simple_paths(starts, e, 1, max_depth, inbound)
    if max_rows is None:
        return found
    w = Window.partitionBy("start_id").orderBy("depth", F.array_join("path", ">"))
    return found.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max_rows).drop("_k")


def bfs_nodes(starts: DataFrame, edges: DataFrame, depth: int, inbound: bool = False) -> DataFrame:
    """start_id, node_id, depth: nodes within ``depth`` hops at their smallest depth, by a visited set."""
    step = saved(steps(edges, inbound))
    level = starts.select(F.col("id").alias("start_id"), F.col("id").alias("node_id"), F.lit(0).cast("long").alias("depth"))
    seen = level
    for n in range(1, depth + 1):
        reached = level.join(step, F.col("node_id") == F.col("_at")).select("start_id", F.col("_to").alias("node_id")).distinct()
        level = saved(reached.join(seen, ["start_id", "node_id"], "left_anti").withColumn("depth", F.lit(n).cast("long")))
        seen = seen.unionByName(level)
    return seen.where("depth > 0")


def expand_callers(graph: Graph, seeds: DataFrame, max_hops: int) -> DataFrame:
    """id, hop: nodes with a path of any edge type into a seed, at their first hop. Seeds unknown to the graph are skipped."""
    known = graph.nodes.select("id")
    step = saved(steps(graph.edges, inbound=True))
    level = saved(seeds.select("id").distinct().join(known, "id", "left_semi").withColumn("hop", F.lit(0).cast("long")))
    seen = level
    for n in range(1, max_hops + 1):
        reached = level.join(step, F.col("id") == F.col("_at")).select(F.col("_to").alias("id")).distinct()
        level = saved(reached.join(seen, "id", "left_anti").join(known, "id", "left_semi").withColumn("hop", F.lit(n).cast("long")))
        seen = seen.unionByName(level)
    return seen.where("hop > 0")


def risk(entry_point, in_degree, depth):
    """The risk level of a reached node: entry points and nodes with many callers first, then by distance."""
    return (
        F.when((entry_point & (depth <= 1)) | (in_degree > 10), "CRITICAL").when((in_degree > 5) | (depth <= 1), "HIGH")
        .when((in_degree > 2) | (depth <= 2), "MEDIUM").otherwise("LOW")
    )


def with_risk(graph: Graph, reached: DataFrame, node: str = "node_id") -> DataFrame:
    """``reached`` with entry_point, in_degree (calls and asynchronous calls) and risk."""
    callers = graph.edges.where(F.col("type").isin(RISK_TYPES)).groupBy(F.col("target_id").alias(node)).agg(F.count(F.lit(1)).alias("in_degree"))
    entry = graph.nodes.select(F.col("id").alias(node), (F.coalesce(prop_number("is_entry_point"), F.lit(0.0)) == 1).alias("entry_point"))
    out = reached.join(callers, node, "left").join(entry, node, "left")
    out = out.withColumn("in_degree", F.coalesce("in_degree", F.lit(0).cast("long"))).withColumn("entry_point", F.coalesce("entry_point", F.lit(False)))
    return out.withColumn("risk", risk(F.col("entry_point"), F.col("in_degree"), F.col("depth")))


def risk_summary(risky: DataFrame) -> DataFrame:
    """risk, n for all four levels, empty ones too."""
    counts = risky.groupBy("risk").agg(F.count(F.lit(1)).alias("n"))
    levels = risky.sparkSession.createDataFrame([(x,) for x in LEVELS], "risk string")
    return levels.join(counts, "risk", "left").select("risk", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def resolve_start(graph: Graph, name: str, project: str | None = None) -> str | None:
    """The id that a name means: among the first 50 nodes whose name contains it, the exact one, else one equal but for case."""
    n = graph.nodes if project is None else graph.nodes.where(F.col("project") == project)
    near = n.where(F.lower("name").contains(name.lower())).orderBy("name", "id").limit(50)
    rank = F.when(F.col("name") == name, 0).when(F.lower("name") == name.lower(), 1)
    row = near.withColumn("_r", rank).where(F.col("_r").isNotNull()).orderBy("_r", "name", "id").first()
    return row["id"] if row else None


def trace(graph: Graph, name: str, direction: str = "both", depth: int = 3, with_risks: bool = False, min_confidence: float = 0.0, project: str | None = None):
    """(nodes, edges, truncated) around the node that ``name`` means, or None. Depth is kept between 1 and 5.

    nodes: node_id, depth, path, direction, once per node, outbound paths first; edges: source_id, target_id, once per pair.
    """
    start = resolve_start(graph, name, project)
    if start is None:
        return None
    depth = max(1, min(5, depth))
    starts = graph.nodes.where(F.col("id") == start).select("id")
    rows, truncated = None, False
    for k, side in enumerate(("outbound", "inbound")):
        if direction in (side, "both"):
            got = saved(bfs_paths(graph, starts, CALL_TYPES, side == "inbound", depth, MOST_ROWS, min_confidence).withColumn("direction", F.lit(side)).withColumn("_side", F.lit(k)))
            truncated = truncated or got.count() >= MOST_ROWS
            rows = got if rows is None else rows.unionByName(got)
    order = [F.col("_side"), F.col("depth"), F.array_join("path", ">")]
    nodes = rows.withColumn("_k", F.row_number().over(Window.partitionBy("node_id").orderBy(*order))).where("_k = 1").drop("_k", "_side")
    pairs = rows.select(F.element_at("path", -2).alias("source_id"), F.col("node_id").alias("target_id")).distinct()
    return (with_risk(graph, nodes) if with_risks else nodes), pairs, truncated


def by_depth(traced: DataFrame) -> DataFrame:
    """depth, node_ids: a trace grouped into its levels."""
    return traced.groupBy("depth").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))


# Labels of symbols.
SYMBOLS = ["Function", "Method", "Class", "Interface", "Type", "Enum"]


def changed_symbols(graph: Graph, changes: DataFrame, labels: list[str] = SYMBOLS) -> DataFrame:
    """Nodes of the files of ``changes`` (path, status) that were not deleted."""
    files = changes.where(F.col("status") != "deleted").select(F.col("path").alias("file_path")).distinct()
    return graph.nodes.where(F.col("label").isin(labels)).join(files, "file_path", "left_semi")


def impact(graph: Graph, changes: DataFrame, depth: int = 3, min_confidence: float = 0.0, labels: list[str] = SYMBOLS, max_rows: int | None = 100) -> DataFrame:
    """Callers of changed symbols, once each at their first depth, with risk; changed symbols themselves are left out."""
    seeds = saved(changed_symbols(graph, changes, labels).select("id"))
    reached = bfs_paths(graph, seeds, CALL_TYPES, True, max(1, min(5, depth)), max_rows, min_confidence)
    least = reached.groupBy("node_id").agg(F.min("depth").alias("depth"))
    return with_risk(graph, least.join(seeds, F.col("node_id") == F.col("id"), "left_anti"))


def session_impact(graph: Graph, changed_files: DataFrame, max_hops: int = 2) -> DataFrame:
    """id, hop: nodes of the changed files (``path``) at hop 0 and their callers; its size is the blast radius."""
    own = graph.nodes.join(changed_files.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select("id")
    return own.withColumn("hop", F.lit(0).cast("long")).unionByName(expand_callers(graph, own, max_hops).join(own, "id", "left_anti"))


def call_path(graph: Graph, start: str, target: str, max_depth: int = 5) -> DataFrame:
    """depth, path: the shortest call path between two ids, the smallest of equals."""
    starts = graph.nodes.where(F.col("id") == start).select("id")
    found = bfs_paths(graph, starts, CALL_TYPES, False, max_depth, None).where(F.col("node_id") == target)
    return found.select("depth", F.array_join("path", ">").alias("path")).orderBy("depth", "path").limit(1)
