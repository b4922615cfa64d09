"""Line dedup by distinct-site spread.

Every line with a word is hashed over its blank-normalised text; HyperLogLog sketches of the sites that show a line merge
by (map-side combined) aggregation. Lines estimated clearly above ``min_sites`` are boilerplate, clearly below are not,
and lines near the threshold get exact distinct counts. A boilerplate line stays where it stands first (smallest doc_id,
first line) and is removed everywhere else.

Null texts stay null, null sites count as one site of their own, null ids sort last, a repeated row is a later occurrence.
Very long texts and lines are read whole. Documents are never dropped; one whose every line goes has an empty text. An
empty table gives an empty result. With ``counts``, own columns named ``n_lines`` or ``n_removed`` are replaced.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, boxed, cut, discard, quoted, unboxed

#: Relative standard error of the sketches, and the band (in shares of the threshold) that is counted exactly.
RSD, LOW, HIGH = 0.1, 0.5, 2.0
#: Boilerplate lines are broadcast up to this number (some 40 bytes each), and joined by a shuffle beyond it.
MOST_BROADCAST = 500_000


def _hash(line):
    return F.xxhash64(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def spread(lines: DataFrame, min_sites: int) -> DataFrame:
    """Hashes of the lines seen on at least ``min_sites`` sites, with their first place. ``lines``: _h, _site, _place."""
    seen = lines.groupBy("_h").agg(F.approx_count_distinct("_site", RSD).alias("_n"), F.min("_place").alias("_first"))
    seen = cut(seen.where(F.col("_n") >= LOW * min_sites))
    near = seen.where(F.col("_n") < HIGH * min_sites)
    # Distinct (line, site) pairs are combined before the shuffle: a line costs at most one row per site and task.
    exact = lines.join(near.select("_h"), "_h", "left_semi").select("_h", "_site").distinct().groupBy("_h").agg(F.count(F.lit(1)).alias("_sites"))
    sure = seen.where(F.col("_n") >= HIGH * min_sites).select("_h", "_first")
    out = cut(sure.unionByName(near.join(exact.where(F.col("_sites") >= min_sites), "_h", "left_semi").select("_h", "_first")))
    discard(seen)
    return out


def dedup(docs: DataFrame, min_sites: int = 5, text: str = "text", site: str = "source", doc_id: str = "doc_id", counts: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines removed; with ``counts`` also n_lines and n_removed (lines with a word)."""
    numbered = cut(docs.select(boxed(docs), F.monotonically_increasing_id().alias("_rid")))
    body, own = F.col(f"_row.{quoted(text)}"), F.col(f"_row.{quoted(doc_id)}")
    lines = numbered.select(
        F.coalesce(F.xxhash64(F.concat(F.lit("="), F.col(f"_row.{quoted(site)}").cast("string"))), F.lit(0).cast("long")).alias("_site"),
        own.isNull().alias("_a"), own.alias("_b"), "_rid", F.posexplode(F.split(body, "\n")).alias("_pos", "_line"),
    ).where(F.regexp_like("_line", F.lit(WORD)))
    # Lines are hashed once and written without their text.
    lines = cut(lines.select(_hash(F.col("_line")).alias("_h"), "_site", F.struct("_a", "_b", "_rid", "_pos").alias("_place")))
    boiler = spread(lines, min_sites)
    few = boiler.count() <= MOST_BROADCAST
    drops = lines.select("_h", "_place").join(F.broadcast(boiler) if few else boiler, "_h").where(F.col("_place") != F.col("_first"))
    drops = cut(drops.groupBy(F.col("_place._rid").alias("_rid")).agg(F.array_sort(F.collect_set("_place._pos")).alias("_gone")))
    discard(lines, boiler)
    # Texts move once, unsorted, at every size.
    out = numbered.join(drops.hint("shuffle_hash"), "_rid", "left").withColumn("_n", F.coalesce(F.size("_gone"), F.lit(0))).withColumn("_n", F.greatest("_n", F.lit(0)))
    # The stretches between removed lines, each cut out once: linear in the lines of a document.
    array, edge = F.split(body, "\n"), lambda a, i: F.when(i < 0, -1).otherwise(F.coalesce(F.get("_gone", i), F.size(a)))
    stretch = lambda a: F.transform(F.sequence(F.lit(0), F.col("_n")), lambda i: F.slice(a, edge(a, i - 1) + 2, edge(a, i) - edge(a, i - 1) - 1))
    cleaned = F.element_at(F.transform(F.array(array), lambda a: F.array_join(F.flatten(stretch(a)), "\n")), 1)
    new = F.when(F.col("_n") > 0, cleaned).otherwise(body)
    worded = F.coalesce(F.size(F.filter(array, lambda s: F.regexp_like(s, F.lit(WORD)))), F.lit(0))
    extra = [("n_lines", F.when(body.isNull(), 0).otherwise(worded).cast("long")), ("n_removed", F.col("_n").cast("long"))] if counts else []
    out = out.select(F.col("_row").withField(quoted(text), new).alias("_row"), *[c.alias(f"_{n}") for n, c in extra])
    return out.select(*unboxed(docs.columns, *[(n, F.col(f"_{n}")) for n, _ in extra]))
