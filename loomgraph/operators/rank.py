"""PageRank with seeds, file scores and normalisation.

A node sends ``damping`` times 0.9 / 0.85 of its score over its edges, parallel edges counted, edges to unknown nodes
left out; a node without edges keeps a share of its own score. Mass is not conserved, by definition.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.paths import saved

# The share a node passes on over its edges, and the share a node without edges keeps.
PASSED, KEPT = 0.9, 0.1


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, damping: float = 0.85, rounds: int = 50, epsilon: float = 1e-6) -> DataFrame:
    """id, score. ``seeds``: id, weight; without a valid seed every node is one. Stops at an L1 change below ``epsilon``.

    A round is (1 - damping) * teleport + damping * received, where the teleport of a seed is its normalised weight and that
    of any other node stays uniform.
    """
    ids = nodes.select("id").distinct()
    n = ids.count()
    if not n:
        return ids.withColumn("score", F.lit(0.0))
    known = edges.select("source_id", "target_id").join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    # Parallel edges become a count, so a round moves one row per pair.
    pairs = known.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("k"))
    out = known.groupBy("source_id").agg(F.count(F.lit(1)).alias("_out"))
    spread = saved(pairs.join(out, "source_id").select(F.col("source_id").alias("id"), "target_id", (F.col("k") * PASSED / F.col("_out")).alias("_w")))
    teleport = ids.withColumn("_t", F.lit(1.0 / n))
    if seeds is not None:
        valid = seeds.groupBy("id").agg(F.sum("weight").alias("weight")).where("weight > 0").join(ids, "id", "left_semi")
        total = valid.agg(F.sum("weight")).first()[0]
        if total:
            teleport = ids.join(valid, "id", "left").select("id", F.coalesce(F.col("weight") / total, F.lit(1.0 / n)).alias("_t"))
    base = saved(teleport.join(out.select(F.col("source_id").alias("id"), F.lit(True).alias("_linked")), "id", "left").withColumn("_linked", F.coalesce("_linked", F.lit(False))))
    scores = saved(base.select("id", F.lit(1.0 / n).alias("score")))
    for _ in range(rounds):
        flow = scores.join(spread, "id").groupBy(F.col("target_id").alias("id")).agg(F.sum(F.col("score") * F.col("_w")).alias("_in"))
        new = base.join(scores, "id").join(flow, "id", "left")
        kept = F.when(F.col("_linked"), 0.0).otherwise(KEPT * F.col("score"))
        new = saved(new.select("id", F.col("score").alias("_old"), ((1 - damping) * F.col("_t") + damping * (F.coalesce("_in", F.lit(0.0)) + kept)).alias("score")))
        moved = new.agg(F.sum(F.abs(F.col("score") - F.col("_old")))).first()[0]
        scores = new.select("id", "score")
        if moved < epsilon:
            break
    return scores


def file_scores(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """file_path, score: the highest positive score of a file's symbols; nodes without a file are left out."""
    joined = nodes.select("id", "file_path").where(F.col("file_path").isNotNull()).join(scores.where("score > 0"), "id")
    return joined.groupBy("file_path").agg(F.max("score").alias("score"))


def normalise(scores: DataFrame) -> DataFrame:
    """Scores divided by the highest; all-zero scores stay."""
    top = scores.agg(F.max("score").alias("_top")).first()["_top"] or 0.0
    return scores.withColumn("score", F.col("score") / top) if top else scores
