"""The change feed as Structured Streaming.

Events (path, kind, ts) are debounced by session windows in event time with a watermark; each drained batch classifies its
hinted paths against the hash table and hands them on. One query runs micro-batches in turn, so one update is in flight.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import store

EVENTS = "path string, kind string, ts timestamp"
INTAKE, SETTLE, LATE = "300 milliseconds", "3 seconds", "1 minute"
# Control events that ask for a whole update, and seconds between sweeps by number of nodes.
CONTROL = ["git-commit", "session-start", "workspace-switch"]
SWEEPS = [(2_000, 60), (5_000, 120), (20_000, 300)]
SLOWEST = 600
SWEEP_FILES = 100
#: Seconds between two guarded updates, and the calls that pass the guard.
GUARD_SECONDS = 60
UNGUARDED = ["index_repository", "index_status", "list_projects", "delete_project", "ping"]


def read_events(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """The event stream from JSON files that appear in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).json(folder)


def debounce(events: DataFrame, gap: str = INTAKE, late: str = LATE, key: str = "path", ts: str = "ts") -> DataFrame:
    """key, start_ts, end_ts, n_events: events of a key at most ``gap`` apart drain together; later than ``late`` they are dropped.

    The same plan serves a stream and a table; on a table the watermark has no effect.
    """
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(key, F.session_window(ts, gap).alias("_w")).agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("n_events")).drop("_w")


def settle(drained: DataFrame, gap: str = SETTLE) -> DataFrame:
    """start_ts, end_ts, paths: the second debounce joins drained batches at most ``gap`` apart into one update."""
    rows = drained.groupBy(F.session_window("end_ts", gap).alias("_w"))
    return rows.agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.array_sort(F.collect_set("path")).alias("paths")).drop("_w")


def once(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each path once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path"])


def sweep_seconds(nodes: int) -> int:
    return next((s for n, s in SWEEPS if nodes < n), SLOWEST)


def sweep_window(hashes: DataFrame, cycle: int, most: int = SWEEP_FILES) -> DataFrame:
    """The catalog rows of one sweep: every row falls in one of the windows, which come round in turn."""
    n = hashes.count()
    windows = max(1, -(-n // most))
    return hashes.where(F.pmod(F.xxhash64("rel_path"), F.lit(windows)) == cycle % windows)


def whole_update(events: DataFrame) -> DataFrame:
    """Control events."""
    return events.where(F.col("kind").isin(CONTROL))


def apply_batch(batch: DataFrame, current: Callable[[], DataFrame], hashes: Callable[[], DataFrame], update: Callable[[DataFrame], None]) -> None:
    """One micro-batch: classify the hinted files, or all after a control event, and update those that changed."""
    hints = batch.select("path").distinct()
    files = current()
    if whole_update(batch).isEmpty():
        files = store.hinted(files, hints)
    states = store.classify(files, hashes()).where("state <> 'unchanged'")
    gone = store.deleted(hashes().join(hints.withColumnRenamed("path", "rel_path"), "rel_path", "left_semi"), current()).select(F.col("rel_path").alias("path"), F.lit("deleted").alias("state"))
    states = states.unionByName(gone)
    if not states.isEmpty():
        update(states)


def start(events: DataFrame, current, hashes, update, checkpoint: str, available_now: bool = False):
    """The running query; ``available_now`` catches up with what is there and stops."""
    writer = events.writeStream.foreachBatch(lambda batch, _: apply_batch(batch, current, hashes, update)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=SETTLE)).start()


def guard(tool: str, nodes: int, signature: str, known: str | None, seconds_since: float) -> str | None:
    """What to do before a tool runs: ``full`` on an empty graph, ``incremental`` when sources changed, at most once a minute."""
    if tool in UNGUARDED or seconds_since < GUARD_SECONDS:
        return None
    return "full" if nodes == 0 else "incremental" if signature != known else None
