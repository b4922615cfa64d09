"""A property graph over the relational tables: the adapter that queries and their SQL twins share.

Parts, suppliers, customers, nations and regions are nodes. Consecutive line items of an order call each other; the call's
type follows the return flag. Regions hold nations, nations hold customers, suppliers belong to nations.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.model import EDGES, NODES, PROJECTS, Graph, complete

PROJECT = "tpch"
#: (application, folder) -> the written edges of that folder.
_WRITTEN: dict[tuple[str, str], str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def parts(spark: SparkSession, d: str) -> DataFrame:
    bag = F.to_json(F.struct(F.col("p_type").alias("kind"), F.col("p_retailprice").alias("price"), (F.col("p_size") == 1).alias("is_entry_point")))
    key = F.concat(F.lit("p"), "p_partkey")
    return complete(table(spark, d, "part").select(
        key.alias("id"), F.lit(PROJECT).alias("project"), F.lit("Part").alias("label"), F.col("p_name").alias("name"), key.alias("qualified_name"),
        F.col("p_brand").alias("file_path"), F.col("p_size").alias("start_line"), (F.col("p_size") + 10).alias("end_line"), bag.alias("props"),
    ), NODES)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    rest = [("Supplier", "supplier", "s", "s_suppkey", "s_name"), ("Customer", "customer", "c", "c_custkey", "c_name"), ("Nation", "nation", "n", "n_nationkey", "n_name"), ("Region", "region", "r", "r_regionkey", "r_name")]
    out = parts(spark, d)
    for label, name, p, key, title in rest:
        at = F.concat(F.lit(p), key)
        out = out.unionByName(complete(table(spark, d, name).select(at.alias("id"), F.lit(PROJECT).alias("project"), F.lit(label).alias("label"), F.col(title).alias("name"), at.alias("qualified_name")), NODES))
    return out


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """source_id, target_id, type, confidence: unique triples, the highest confidence of each."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_discount")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_discount")
    rows = rows.withColumn("next", F.lead("l_partkey").over(w)).where(F.col("next") != F.col("l_partkey"))
    kind = F.when(F.col("l_returnflag") == "N", "CALLS").when(F.col("l_returnflag") == "A", "ASYNC_CALLS").otherwise("HTTP_CALLS")
    return rows.groupBy(F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.concat(F.lit("p"), "next").alias("target_id"), kind.alias("type")).agg(
        F.round(1 - F.min("l_discount"), 2).alias("confidence")
    )


def _all_edges(spark: SparkSession, d: str) -> DataFrame:
    def link(name, source, p, target, q, kind):
        return table(spark, d, name).select(F.concat(F.lit(p), source).alias("source_id"), F.concat(F.lit(q), target).alias("target_id"), F.lit(kind).alias("type"), F.lit(1.0).alias("confidence"))

    out = _calls(spark, d).unionByName(link("nation", "n_regionkey", "r", "n_nationkey", "n", "CONTAINS_FOLDER"))
    out = out.unionByName(link("customer", "c_nationkey", "n", "c_custkey", "c", "CONTAINS_FILE"))
    return complete(out.unionByName(link("supplier", "s_suppkey", "s", "s_nationkey", "n", "MEMBER_OF")).withColumn("project", F.lit(PROJECT)), EDGES)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """All edges. They are derived once an application and written, partitioned by type, so that a query reads the types it names."""
    key = (spark.sparkContext.applicationId, d)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    if key in _WRITTEN:
        at = hadoop(_WRITTEN[key] + "/_SUCCESS")
        if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
            return complete(spark.read.parquet(_WRITTEN[key]), EDGES)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            return _all_edges(spark, d)
        base = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    path = f"{base.rstrip('/')}/edges-{uuid.uuid4().hex}"
    # One task a type and key range, not a file per task and type.
    _all_edges(spark, d).repartition("type", F.pmod(F.xxhash64("source_id"), F.lit(16))).write.partitionBy("type").parquet(path)
    _WRITTEN[key] = path
    return complete(spark.read.parquet(path), EDGES)


def calls(spark: SparkSession, d: str) -> DataFrame:
    """The call edges between parts."""
    return edges(spark, d).where(F.col("type").isin("CALLS", "ASYNC_CALLS", "HTTP_CALLS"))


def property_graph(spark: SparkSession, d: str) -> Graph:
    projects = complete(spark.createDataFrame([(PROJECT, "/data/tpch")], "name string, root_path string"), PROJECTS)
    return Graph(nodes(spark, d), edges(spark, d), projects)


#: The same relations as common table expressions.
SQL = """
nodes AS (
  SELECT 'p' || p_partkey AS id, 'tpch' AS project, 'Part' AS label, p_name AS name, p_brand AS file_path, p_size AS start_line, p_size + 10 AS end_line, p_type AS kind, p_retailprice AS price, p_size = 1 AS entry FROM part
  UNION ALL SELECT 's' || s_suppkey, 'tpch', 'Supplier', s_name, NULL, NULL, NULL, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'tpch', 'Customer', c_name, NULL, NULL, NULL, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'tpch', 'Nation', n_name, NULL, NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'tpch', 'Region', r_name, NULL, NULL, NULL, NULL, NULL, NULL FROM region),
steps AS (
  SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_discount) AS nxt FROM lineitem),
edges AS MATERIALIZED (
  SELECT 'p' || l_partkey AS source_id, 'p' || nxt AS target_id,
    CASE l_returnflag WHEN 'N' THEN 'CALLS' WHEN 'A' THEN 'ASYNC_CALLS' ELSE 'HTTP_CALLS' END AS type, round(1 - min(l_discount), 2) AS confidence
  FROM steps WHERE nxt <> l_partkey GROUP BY 1, 2, 3
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'CONTAINS_FOLDER', 1.0 FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'CONTAINS_FILE', 1.0 FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'MEMBER_OF', 1.0 FROM supplier)
"""
