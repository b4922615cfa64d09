"""Co-change mining and debounced sessions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def co_changes(changes: DataFrame, least: int = 3, most: int = 20) -> DataFrame:
    """file_a, file_b, count: pairs of files changed together in ``least`` commits or more, of commits with 2 to ``most`` files."""
    files = changes.select("commit", "file").distinct()
    fine = files.groupBy("commit").agg(F.array_sort(F.slice(F.collect_set("file"), 1, most + 1)).alias("f"))
    fine = fine.where((F.size("f") > 1) & (F.size("f") <= most))
    # At most 190 pairs a commit, made inside its row.
    pairs = fine.select(F.explode(F.flatten(F.transform("f", lambda a, i: F.transform(F.slice("f", i + 2, F.lit(most)), lambda b: F.struct(a.alias("file_a"), b.alias("file_b")))))).alias("p"))
    return pairs.groupBy("p.file_a", "p.file_b").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least)
