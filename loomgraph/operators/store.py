"""Changes to a graph: every operator takes snapshots and gives new ones. Snapshots are written beside each other and a
pointer names the current one, so a change is seen whole or not at all."""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.model import EDGES, HASHES, NODES, PROJECTS, Graph, complete

ADR_MOST = 8000
# Sections of a decision record.
SECTIONS = ["PURPOSE", "STACK", "ARCHITECTURE", "PATTERNS", "TRADEOFFS", "PHILOSOPHY"]


def last_wins(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; of several new rows of a key the last by ``order`` counts.

    One aggregation by key, combined before the shuffle; no window.
    """
    rest = [c for c in old.columns if c not in keys]
    rank = F.col(order) if order else F.lit(0)
    rows = old.select("*", F.lit(0).alias("_new"), F.lit(0).cast("long").alias("_o")).unionByName(new.select(*old.columns, F.lit(1).alias("_new"), rank.cast("long").alias("_o")))
    best = rows.groupBy(*keys).agg(F.max(F.struct("_new", "_o", *rest)).alias("_b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in old.columns])


def upsert_nodes(graph: Graph, nodes: DataFrame, order: str | None = None) -> Graph:
    """Nodes by id. Edges of replaced nodes stay."""
    more = complete(nodes, NODES)
    return graph.with_(nodes=last_wins(graph.nodes, more.withColumn(order, nodes[order]) if order else more, ["id"], order))


def referential(edges: DataFrame, nodes: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Edges whose two ends exist (with one of ``labels``)."""
    ids = (nodes.where(F.col("label").isin(labels)) if labels else nodes).select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def upsert_edges(graph: Graph, edges: DataFrame, order: str | None = None, strict: bool = False) -> Graph:
    """Edges by (source, target, type). Those with a missing end are dropped, or raise where ``strict``."""
    more = edges.select(*complete(edges, EDGES).columns, order) if order else complete(edges, EDGES)
    fine = referential(more, graph.nodes)
    if strict and (bad := more.count() - fine.count()):
        raise ValueError(f"{bad} edges have an end that does not exist")
    return graph.with_(edges=last_wins(graph.edges, fine, ["source_id", "target_id", "type"], order))


def supersede_edges(graph: Graph, edges: DataFrame) -> Graph:
    """For every (source, type) that ``edges`` holds, its edges replace the old ones."""
    more = complete(edges, EDGES)
    kept = graph.edges.join(more.select("source_id", "type").distinct(), ["source_id", "type"], "left_anti")
    return graph.with_(edges=kept.select(*graph.edges.columns).unionByName(more))


def _cascade(graph: Graph, nodes: DataFrame) -> Graph:
    return graph.with_(nodes=nodes, edges=referential(graph.edges, nodes).select(*graph.edges.columns))


def delete_nodes(graph: Graph, ids: DataFrame | None = None, project: str | None = None, files: DataFrame | None = None, path_part: str | None = None) -> Graph:
    """Nodes by ``ids`` (id), project, ``files`` (path) or a part of their path; their edges go with them."""
    n = graph.nodes
    if ids is not None:
        n = n.join(ids.select("id"), "id", "left_anti")
    if project is not None:
        n = n.where(~F.col("project").eqNullSafe(project))
    if files is not None:
        n = n.join(files.select(F.col("path").alias("file_path")), "file_path", "left_anti")
    if path_part is not None:
        n = n.where(~F.coalesce(F.col("file_path").contains(path_part), F.lit(False)))
    return _cascade(graph, n.select(*graph.nodes.columns))


def delete_edges(graph: Graph, project: str | None = None, source: str | None = None, type: str | None = None) -> Graph:
    """Edges that match every given column."""
    hit = F.lit(True)
    for column, value in (("project", project), ("source_id", source), ("type", type)):
        if value is not None:
            hit = hit & (F.col(column) == value)
    return graph.with_(edges=graph.edges.where(~F.coalesce(hit, F.lit(False))))


def update_props(graph: Graph, new: DataFrame) -> Graph:
    """Replace the property bags of ``new`` (id, props)."""
    n = graph.nodes.join(new.select("id", F.col("props").alias("_p")), "id", "left")
    return graph.with_(nodes=n.withColumn("props", F.coalesce("_p", "props")).select(*graph.nodes.columns))


def upsert_projects(graph: Graph, projects: DataFrame) -> Graph:
    """Projects by name; an existing one keeps its last_opened_at."""
    new = complete(projects, PROJECTS).select(F.col("name"), *[F.col(c).alias(f"_{c}") for c in complete(projects, PROJECTS).columns[1:]])
    out = graph.projects.join(new, "name", "full_outer")
    keep = F.coalesce("last_opened_at", "_last_opened_at", F.lit(0).cast("long")).alias("last_opened_at")
    return graph.with_(projects=out.select("name", *[F.coalesce(f"_{c}", c).alias(c) for c in graph.projects.columns if c not in ("name", "last_opened_at")], keep).select(*graph.projects.columns))


def touch_project(graph: Graph, name: str, now_ms: int) -> Graph:
    return graph.with_(projects=graph.projects.withColumn("last_opened_at", F.when(F.col("name") == name, F.lit(now_ms)).otherwise(F.col("last_opened_at")).cast("long")))


def upsert_hashes(graph: Graph, hashes: DataFrame) -> Graph:
    return graph.with_(hashes=last_wins(graph.hashes, complete(hashes, HASHES), ["project", "rel_path"]))


def delete_project(graph: Graph, name: str, hashes_too: bool = False) -> Graph:
    """The project with its nodes and edges; ``hashes_too`` prunes its file hashes as well."""
    out = delete_nodes(graph, project=name)
    out = out.with_(edges=out.edges.where(~F.col("project").eqNullSafe(name)), projects=graph.projects.where(F.col("name") != name))
    return out.with_(hashes=graph.hashes.where(F.col("project") != name)) if hashes_too else out


def prune_report(graph: Graph, name: str) -> dict[str, int]:
    """Numbers of nodes and edges that pruning a project takes away."""
    return {"nodes": graph.nodes.where(F.col("project") == name).count(), "edges": graph.edges.where(F.col("project") == name).count()}


def expired(projects: DataFrame, now_ms: int, days: int) -> DataFrame:
    """Projects opened once but not within ``days``."""
    return projects.where((F.col("last_opened_at") != 0) & (F.col("last_opened_at") < now_ms - days * 86_400_000))


def prune_expired(graph: Graph, now_ms: int, days: int) -> Graph:
    gone = expired(graph.projects, now_ms, days).select(F.col("name").alias("project"))
    nodes = graph.nodes.join(gone, "project", "left_anti").select(*graph.nodes.columns)
    out = _cascade(graph, nodes)
    return out.with_(
        projects=graph.projects.join(gone.withColumnRenamed("project", "name"), "name", "left_anti").select(*graph.projects.columns),
        hashes=graph.hashes.join(gone, "project", "left_anti").select(*graph.hashes.columns),
    )


def purge_skipped(graph: Graph, part: str = ".claude/worktrees/") -> Graph:
    """Nodes of paths that are never indexed go."""
    return delete_nodes(graph, path_part=part)


def upsert_metadata(table: DataFrame, key: str, value: str) -> DataFrame:
    """``table`` (key, value) with one key set."""
    return table.where(F.col("key") != key).unionByName(table.sparkSession.createDataFrame([(key, value)], "key string, value string"))


def merge_adr(old: dict | None, sections: dict) -> dict:
    """A decision record with sections replaced; unknown sections and too long records raise."""
    if bad := [s for s in sections if s not in SECTIONS]:
        raise ValueError(f"unknown sections: {', '.join(bad)}")
    out = {**(old or {}), **sections}
    if len(json.dumps(out)) > ADR_MOST:
        raise ValueError(f"a record has at most {ADR_MOST} characters")
    return out


def catalog_hash(hashes: DataFrame, project: str = "project", path: str = "rel_path", content: str = "content_hash") -> DataFrame:
    """project, catalog_hash: a hash of (path, content hash) lines in path order.

    Lines hash one by one first; a project's list holds 64 characters a file.
    """
    line = F.concat(F.col(path), F.lit("\0"), F.col(content))
    rows = hashes.groupBy(project).agg(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), line.alias("l")))).alias("_l"))
    return rows.select(project, F.sha2(F.array_join(F.transform("_l", lambda x: x["l"]), "\n"), 256).alias("catalog_hash"))


def verify_catalog(hashes: DataFrame, stored: DataFrame, project: str = "project") -> DataFrame:
    """project, valid: true where no hash is stored."""
    now = catalog_hash(hashes, project)
    then = stored.select(project, F.col("catalog_hash").alias("_was"))
    return now.join(then, project, "left").select(project, (F.col("_was").isNull() | (F.col("_was") == F.col("catalog_hash"))).alias("valid"))


def classify(current: DataFrame, stored: DataFrame) -> DataFrame:
    """path, state of current files: added, changed or unchanged; equal stats skip the comparison of hashes.

    ``current`` and ``stored``: rel_path, content_hash, mtime_ns, size.
    """
    then = stored.select("rel_path", F.col("content_hash").alias("_h"), F.col("mtime_ns").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_known"))
    same_stat = (F.col("mtime_ns") == F.col("_m")) & (F.col("size") == F.col("_s"))
    state = F.when(F.col("_known").isNull(), "added").when(same_stat | (F.col("content_hash") == F.col("_h")), "unchanged").otherwise("changed")
    return current.join(then, "rel_path", "left").select(F.col("rel_path").alias("path"), state.alias("state"))


def hinted(current: DataFrame, hints: DataFrame) -> DataFrame:
    """The current files that hints name; unknown hints are ignored."""
    return current.join(hints.select(F.col("path").alias("rel_path")).distinct(), "rel_path", "left_semi")


def deleted(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored files that are gone."""
    return stored.join(current.select("rel_path"), "rel_path", "left_anti")


def project_name(root: str) -> str:
    """The name of the project at a root folder."""
    base = root.rstrip("/").rsplit("/", 1)[-1].lower()
    return "".join(c if c.isascii() and (c.isalnum() or c == "-") else "-" for c in base)


def migrate(graph: Graph) -> Graph:
    """Tables of older snapshots with the columns added since, at their defaults."""
    projects = complete(graph.projects, PROJECTS)
    return Graph(complete(graph.nodes, NODES), complete(graph.edges, EDGES), projects.withColumn("last_opened_at", F.coalesce("last_opened_at", F.lit(0).cast("long"))), complete(graph.hashes, HASHES))


class Snapshots:
    """Versions of a graph under one folder; writing a version and moving the pointer is the transaction."""

    TABLES = {"nodes": NODES, "edges": EDGES, "projects": PROJECTS, "hashes": HASHES}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def version(self) -> str | None:
        fs, at = self._fs("current")
        return self.spark.read.text(f"{self.root}/current").first()[0] if fs.exists(at) else None

    def read(self) -> Graph:
        at = f"{self.root}/{self.version()}"
        return Graph(**{t: self.spark.read.schema(s).parquet(f"{at}/{t}") for t, s in self.TABLES.items()})

    def write(self, graph: Graph) -> str:
        """A new version; a failure before the pointer moves leaves the old one in place."""
        version = uuid.uuid4().hex
        for t, s in self.TABLES.items():
            table = getattr(graph, t)
            (complete(table, s) if table is not None else self.spark.createDataFrame([], s)).write.parquet(f"{self.root}/{version}/{t}")
        self.spark.createDataFrame([(version,)], "v string").coalesce(1).write.mode("overwrite").text(f"{self.root}/next")
        fs, at = self._fs("current")
        fs.delete(at, True)
        fs.rename(self._fs("next")[1], at)
        return version


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, where the whole row is wanted in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
