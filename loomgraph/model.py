"""The property graph: tables and their columns."""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "id string, project string, label string, name string, qualified_name string, file_path string, start_line int, end_line int, props string"
EDGES = "project string, source_id string, target_id string, type string, props string, confidence double"
PROJECTS = "name string, root_path string, indexed_at long, node_count long, edge_count long, last_opened_at long"
HASHES = "project string, rel_path string, content_hash string, mtime_ns long, size long"


def columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


@dataclass(frozen=True)
class Graph:
    """Immutable snapshot; every operator that changes it gives a new one."""

    nodes: DataFrame
    edges: DataFrame
    projects: DataFrame | None = None
    hashes: DataFrame | None = None

    def with_(self, **tables) -> "Graph":
        return replace(self, **tables)


def complete(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with all columns of ``schema`` in order; missing ones are null, ``props`` is empty, ``confidence`` is one."""
    default = {"props": F.lit("{}"), "confidence": F.lit(1.0)}
    out = []
    for part in schema.split(", "):
        name, kind = part.split()
        value = F.col(name) if name in df.columns else default.get(name, F.lit(None))
        if name in default and name in df.columns:
            value = F.coalesce(value, default[name])
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


def empty(spark: SparkSession) -> Graph:
    return Graph(*(spark.createDataFrame([], s) for s in (NODES, EDGES, PROJECTS, HASHES)))


def prop(key: str, props="props"):
    """A property of the JSON bag as text, null where it is missing."""
    return F.get_json_object(props, f"$.{key}")


def prop_number(key: str, props="props"):
    """A property as a number; JSON true is 1 and false is 0."""
    text = prop(key, props)
    return F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))
