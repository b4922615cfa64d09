"""Search, degrees, counts, schema and architecture summaries over a graph."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.model import Graph, prop, prop_number

# Layers in order, each with the words that name it in a folder's path.
LAYERS = [
    ("Presentation", ["component", "view", "page", "renderer", "ui", "frontend"]),
    ("API/Routes", ["route", "api", "controller", "handler", "endpoint"]),
    ("Business Logic", ["service", "usecase", "domain", "logic", "core"]),
    ("Data Access", ["model", "repo", "database", "store", "db", "data"]),
    ("Configuration", ["config", "setting", "env"]),
    ("Infrastructure", ["infra", "deploy", "docker", "ci", "scripts"]),
]


def glob_regex(pattern: str) -> str:
    """A file glob as an unanchored regular expression: ``**`` any path, ``*`` within a segment, ``?`` one character."""
    out = {"**": ".*", "*": "[^/]*", "?": ".", ".": r"\."}
    return re.sub(r"\*\*|[*?.]", lambda m: out[m.group()], pattern)


def degrees(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, direction: str = "both") -> DataFrame:
    """``nodes`` with ``degree`` (0 where there is no edge); in both directions a self-loop counts once."""
    e = edges.where(F.col("type").isin(types)) if types else edges
    if direction == "both":
        ends = e.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"))
    else:
        ends = e.select(F.col("target_id" if direction == "inbound" else "source_id").alias("id"))
    total = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(total, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def not_entry_point() -> Column:
    """Entry points go, and so do nodes that do not say."""
    return prop_number("is_entry_point") != 1


def search_nodes(
    graph: Graph, query: str | None = None, label: str | None = None, project: str | None = None, file_pattern: str | None = None, types: list[str] | None = None, direction: str = "both",
    min_degree: int | None = None, max_degree: int | None = None, exclude_entry_points: bool = False, case_sensitive: bool = False,
) -> DataFrame:
    """All nodes that pass the filters; a degree filter adds ``degree``."""
    n = graph.nodes
    for column, text in (("name", query), ("file_path", file_pattern)):
        if text:
            n = n.where(F.col(column).contains(text) if case_sensitive else F.lower(column).contains(text.lower()))
    for column, value in (("label", label), ("project", project)):
        if value is not None:
            n = n.where(F.col(column) == value)
    if exclude_entry_points:
        n = n.where(not_entry_point())
    if min_degree is not None or max_degree is not None or types:
        n = degrees(n, graph.edges, types, direction)
        if min_degree is not None:
            n = n.where(F.col("degree") >= min_degree)
        if max_degree is not None:
            n = n.where(F.col("degree") <= max_degree)
    return n


def page(found: DataFrame, limit: int = 20, offset: int = 0) -> tuple[DataFrame, int, bool]:
    """(rows ordered by name, total, has_more)."""
    total = found.count()
    return found.orderBy("name", "id").offset(offset).limit(limit), total, offset + limit < total


def search_ranked(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes with ``rank``: 0 exact name, 1 prefix, 2 elsewhere in the name; only the exact tier minds case."""
    like = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    rank = F.when(F.col("name") == query, 0).when(F.col("name").ilike(like + "%"), 1).when(F.col("name").ilike("%" + like + "%"), 2)
    return nodes.withColumn("rank", rank).where(F.col("rank").isNotNull())


def rank_headings(ranked: DataFrame) -> DataFrame:
    """Ranked rows with ``heading``: true where a rank begins."""
    first = ranked.groupBy("rank").agg(F.min(F.struct("name", "id")).alias("_first"))
    return ranked.join(F.broadcast(first), "rank").withColumn("heading", F.struct("name", "id") == F.col("_first")).drop("_first")


def search_scored(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Nodes with ``score``: 100 exact, 80 prefix, 60 substring, all without case; the best ``limit``."""
    low, q = F.lower("name"), query.lower()
    score = F.when(low == q, 100).when(low.startswith(q), 80).when(low.contains(q), 60)
    return nodes.withColumn("score", score).where(F.col("score").isNotNull()).orderBy(F.desc("score"), "name", "id").limit(limit)


def search_trigram(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose name, qualified name or path contains the query; under three characters nothing matches."""
    if len(query) < 3:
        return nodes.where("false")
    q, test = query.lower(), F.lit(False)
    for c in ("name", "qualified_name", "file_path"):
        test = test | F.coalesce(F.lower(c).contains(q), F.lit(False))
    return nodes.where(test)


def trigrams(nodes: DataFrame) -> DataFrame:
    """trigram, id: an inverted index to keep beside a table that is searched often."""
    text = F.lower(F.concat_ws("\n", "name", "qualified_name", "file_path"))
    grams = F.when(F.length(text) >= 3, F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substr(text, i, F.lit(3))))
    return nodes.select("id", F.explode(F.array_distinct(grams)).alias("trigram")).select("trigram", "id")


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def totals(graph: Graph) -> DataFrame:
    """nodes, edges: sums of the counts by label and by type."""
    n, e = label_counts(graph.nodes).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes")), type_counts(graph.edges).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))
    return n.withColumn("_one", F.lit(1)).join(F.broadcast(e.withColumn("_one", F.lit(1))), "_one").select("nodes", "edges")  # one row each


def relationship_patterns(graph: Graph) -> DataFrame:
    """source_label, type, target_label: each combination once."""
    ends = lambda side: graph.nodes.select(F.col("id").alias(f"{side}_id"), F.col("label").alias(f"{side}_label"))
    return graph.edges.select("source_id", "type", "target_id").join(ends("source"), "source_id").join(ends("target"), "target_id").select("source_label", "type", "target_label").distinct()


def projects(graph: Graph) -> DataFrame:
    """Projects by name with live counts."""
    n, e = graph.nodes.groupBy(F.col("project").alias("name")).count(), graph.edges.groupBy(F.col("project").alias("name")).count()
    out = graph.projects.drop("node_count", "edge_count").join(n.withColumnRenamed("count", "node_count"), "name", "left").join(e.withColumnRenamed("count", "edge_count"), "name", "left")
    return out.na.fill(0, ["node_count", "edge_count"]).orderBy("name")


def languages(nodes: DataFrame) -> DataFrame:
    """language, n of File nodes; a missing language is ``unknown``."""
    return nodes.where("label = 'File'").groupBy(F.coalesce(prop("language"), F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def layer(path) -> Column:
    """The first layer that a word of a folder's path names, or null."""
    out, low = None, F.lower(path)
    for name, words in LAYERS:
        test = low.contains(words[0])
        for w in words[1:]:
            test = test | low.contains(w)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def layers(folders: DataFrame, path="path", name="name") -> DataFrame:
    """layer, folders (sorted names)."""
    return folders.withColumn("layer", layer(F.col(path))).where(F.col("layer").isNotNull()).groupBy("layer").agg(F.array_sort(F.collect_list(name)).alias("folders"))


def hotspots(graph: Graph, labels=("Function", "Method"), types=None, most: int = 20) -> DataFrame:
    """id, degree: the nodes with most edges."""
    return degrees(graph.nodes.where(F.col("label").isin(list(labels))), graph.edges, types).orderBy(F.desc("degree"), "id").limit(most).select("id", "degree")


def entry_points(nodes: DataFrame, window: int = 1000) -> DataFrame:
    """Entry points among the first ``window`` symbols by name."""
    symbols = nodes.where(F.col("label").isin("Function", "Method")).orderBy("name", "id").limit(window)
    return symbols.where(prop_number("is_entry_point") == 1)


def file_tree(paths: DataFrame, path: str = "path") -> DataFrame:
    """path, line: sorted paths, each name indented by its depth."""
    parts = F.split(path, "/")
    return paths.select(path).distinct().orderBy(path).select(F.col(path).alias("path"), F.concat(F.repeat(F.lit("  "), F.size(parts) - 1), F.element_at(parts, -1)).alias("line"))


def graph_schema(graph: Graph) -> dict[str, DataFrame]:
    """Counts, patterns and sample names."""
    sample = lambda label, column, most: graph.nodes.where(F.col("label") == label).select(column).orderBy(column).limit(most)
    return {
        "labels": label_counts(graph.nodes), "types": type_counts(graph.edges), "patterns": relationship_patterns(graph),
        "functions": sample("Function", "name", 10), "classes": sample("Class", "name", 10), "qualified_names": graph.nodes.select("qualified_name").orderBy("qualified_name").limit(5),
    }


ASPECTS = ["languages", "packages", "entry_points", "routes", "hotspots", "file_tree", "layers"]


def architecture(graph: Graph, aspects=("all",)) -> dict[str, DataFrame]:
    """The chosen summaries; ``all`` gives every one. Aspects without a computation give nothing."""
    chosen = ASPECTS if "all" in aspects else [a for a in aspects if a in ASPECTS]
    of = lambda label: graph.nodes.where(F.col("label") == label)
    make = {
        "languages": lambda: languages(graph.nodes).orderBy(F.desc("n"), "language"), "packages": lambda: of("Package").select("name").orderBy("name"),
        "entry_points": lambda: entry_points(graph.nodes), "routes": lambda: of("Route").select("name", prop("method").alias("method"), prop("path").alias("path")),
        "hotspots": lambda: hotspots(graph), "file_tree": lambda: file_tree(of("File").select(F.col("file_path").alias("path"))),
        "layers": lambda: layers(of("Folder").select("name", prop("path").alias("path"))),
    }
    return {a: make[a]() for a in chosen}


def dependencies(graph: Graph, node_id: str) -> DataFrame:
    """direction, id, type: what a node points to and what points to it."""
    out = graph.edges.where(F.col("source_id") == node_id).select(F.lit("dependency").alias("direction"), F.col("target_id").alias("id"), "type")
    return out.unionByName(graph.edges.where(F.col("target_id") == node_id).select(F.lit("dependent").alias("direction"), F.col("source_id").alias("id"), "type"))


def typeof_references(graph: Graph, symbol: str) -> DataFrame:
    """Sources of TYPEOF_REFERENCES to nodes of exactly this name, by file and line."""
    targets = graph.nodes.where(F.lower("name").contains(symbol.lower())).orderBy("name", "id").limit(50).where(F.col("name") == symbol).select(F.col("id").alias("target_id"))
    e = graph.edges.where("type = 'TYPEOF_REFERENCES'").join(F.broadcast(targets), "target_id")
    n = graph.nodes.select(F.col("id").alias("source_id"), F.col("file_path").alias("file"))
    return e.join(n, "source_id").select("file", prop("line").cast("int").alias("line"), prop("pattern").alias("pattern"), prop("context").alias("context"), "target_id").orderBy("file", "line")


def node_by_legacy_id(graph: Graph, legacy_id: str) -> DataFrame:
    """The node that ``path::name::type::line`` means: the first of that exact name among ten."""
    name = legacy_id.split("::")[1] if "::" in legacy_id else legacy_id
    return graph.nodes.where(F.lower("name").contains(name.lower())).orderBy("name", "id").limit(10).where(F.col("name") == name).limit(1)


def symbol_for_snippet(graph: Graph, symbol: str) -> tuple[str | None, list[str]]:
    """(id, candidates): the id meant by an id or a unique exact name; several candidates mean it is ambiguous."""
    if graph.nodes.where(F.col("id") == symbol).limit(1).count():
        return symbol, []
    near = graph.nodes.where(F.lower("name").contains(symbol.lower())).orderBy("name", "id").limit(5)
    ids = [r["id"] for r in near.where(F.col("name") == symbol).select("id").collect()]
    return (ids[0], []) if len(ids) == 1 else (None, ids)


def snippets(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """id, snippet: lines start to end of a node's file. ``files``: path, text."""
    joined = nodes.where("start_line IS NOT NULL AND end_line IS NOT NULL").join(files.select(F.col("path").alias("file_path"), "text"), "file_path")
    return joined.select("id", F.array_join(F.slice(F.split("text", "\n"), F.greatest("start_line", F.lit(1)), F.greatest(F.col("end_line") - F.greatest("start_line", F.lit(1)) + 1, F.lit(0))), "\n").alias("snippet"))


def search_code(files: DataFrame, pattern: str, file_pattern: str | None = None, regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """path, line_no (from 1), line (200 characters), match_start, match_end: one row per matching line, its first match.

    A pattern that is no regular expression matches nothing. ``files``: path, text.
    """
    source = pattern if regex else re.escape(pattern)
    try:
        re.compile(source)
    except re.error:
        source = "(?!)"
    source = ("" if case_sensitive else "(?i)") + source
    f = files.where(F.col("path").rlike(glob_regex(file_pattern))) if file_pattern else files
    # Most files hold no match: whole texts are tested before they are split.
    lines = f.where(F.col("text").rlike(source.replace("(?i)", "(?mi)", 1) if "^" in source or "$" in source else source))
    lines = lines.select("path", F.posexplode(F.split("text", "\n")).alias("_pos", "_line")).where(F.col("_line").rlike(source))
    begin = F.regexp_instr("_line", F.lit(source)) - 1
    match = F.regexp_substr("_line", F.lit(source))
    return lines.select("path", (F.col("_pos") + 1).cast("long").alias("line_no"), F.substring("_line", 1, 200).alias("line"), begin.cast("long").alias("match_start"), (begin + F.length(match)).cast("long").alias("match_end"))


def legacy_counts(graph: Graph) -> DataFrame:
    """nodes, edges, files."""
    n = graph.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("file_path").alias("files")).withColumn("_one", F.lit(1))
    e = graph.edges.agg(F.count(F.lit(1)).alias("edges")).withColumn("_one", F.lit(1))
    return n.join(F.broadcast(e), "_one").select("nodes", "edges", "files")


# Legacy node types by label, and legacy edge types by type.
LEGACY_LABELS = {
    "File": "file", "Function": "function", "Method": "function", "Class": "class", "Interface": "interface", "Type": "type_alias", "Variable": "variable", "Module": "module", "Export": "export",
}
LEGACY_TYPES = {
    "IMPORTS": "imports", "EXPORTS": "exports", "CALLS": "calls", "ASYNC_CALLS": "calls", "HTTP_CALLS": "calls", "DEFINES": "contains", "DEFINES_METHOD": "contains",
    "CONTAINS_FILE": "contains", "CONTAINS_FOLDER": "contains", "CONTAINS_PACKAGE": "contains", "IMPLEMENTS": "implements", "EXTENDS": "extends",
}


def _mapped(column: str, table: dict[str, str], default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.col(column)), F.lit(default))


def legacy_projection(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the older model: id ``path::name::type::line``, eight node types, seven edge types."""
    kind = _mapped("label", LEGACY_LABELS, "variable")
    n = graph.nodes.select(F.concat_ws("::", F.coalesce("file_path", F.lit("")), "name", kind, F.coalesce("start_line", F.lit(0)).cast("string")).alias("id"), kind.alias("type"), "name", F.col("file_path").alias("filePath"), F.col("start_line").alias("line"), F.col("end_line").alias("endLine"))
    return n, graph.edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), _mapped("type", LEGACY_TYPES, "depends_on").alias("type"))
