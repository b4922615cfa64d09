"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source's words, in a seeded order of its documents and dealt over shards, form equal blocks. All blocks of the mix go
to (source, shard) cells by highest quotients target / (2k + 1), which gives integer quotas; a cell's quota takes every
block equally often and the rest by a seeded affine permutation of its blocks.

Null or empty texts have size 0 and are never taken. Null sources are one source, sorted last. Rows with equal ids and
sizes are interchangeable; null ids are spread over the shards. Very long texts are counted whole and may span many blocks.
An empty table gives an empty result. Own columns named ``size``, ``source_size``, ``target`` or ``taken`` are replaced.

The driver holds one row per source and shard, never documents: a shard has ``SHARD_WORDS`` words, or a 65 536th of all
words where that is more, so there are at most 65 536 shards and one a source, at every size.
"""

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import boxed, cut, discard, n_words, quoted, unboxed

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SHARD_WORDS, SHARDS = 50_000, 65_536


def _div(a, b):
    """Exact integer division of non-negative longs."""
    return F.round((a - a % b) / b).cast("long")


def targets(sizes: list[int], weights=WEIGHTS, most: int = MAX_REPEAT) -> list[float]:
    """Share sum(sizes) by repeating weights; a target stops at ``most`` times its size and the excess is reshared."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        whole = sum(w[i] for i in free)
        over = [i for i in free if left * w[i] / whole > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * w[i] / whole
            break
        for i in over:
            out[i] = float(most * sizes[i])
        free -= set(over)
        left = float(sum(sizes)) - sum(out[i] for i in range(len(sizes)) if i not in free)
    return out


def sainte_lague(shares: list[float], seats: int) -> list[int]:
    """Seats by highest quotients share / (2k + 1); ties go to the earlier cell. Starts from a safe lower bound."""
    whole = sum(shares)
    if not whole or not seats:
        return [0] * len(shares)
    # Seats with share / (2k - 1) above the final threshold are certain: a divisor a little too large finds those.
    divisor = whole / seats
    while True:
        got = [max(0, math.ceil(s / divisor - 0.5)) for s in shares]
        if sum(got) <= seats:
            break
        divisor *= 1 + max(1e-9, (sum(got) - seats) / seats)
    heap = [(-s / (2 * q + 1), i) for i, (s, q) in enumerate(zip(shares, got)) if s > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (-shares[i] / (2 * got[i] + 1), i))
    return got


def _seeded(*parts: int) -> int:
    x = 0x9E3779B97F4A7C15
    for p in parts:
        x = (x ^ (p & (1 << 64) - 1)) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x ^= x >> 29
    return x


def _taken(slim: DataFrame, weights, seed: int) -> tuple[DataFrame, DataFrame]:
    """``slim`` (_src, _size, _id, _rid and more, written) with _source_size, _target, _taken and _before, and a frame to discard.

    ``_before`` is the sum of the taken shares of the rows before this one in its cell, in millionths.
    """
    spark = slim.sparkSession
    # Null sorts last; UTF-8 byte order is code point order.
    by_source = sorted(((r["_src"] == "null", r["_src"].encode(), r["_src"], r["n"] or 0) for r in slim.groupBy("_src").agg(F.sum("_size").alias("n")).collect()))
    sizes = [r[3] for r in by_source]
    goals, total = targets(sizes, weights), sum(sizes)
    block = max(1, min(32, 1 + total // 100_000))
    per_shard = max(SHARD_WORDS, -(-total // SHARDS))
    info = [(r[2], n, float(g), max(1, n // per_shard)) for r, n, g in zip(by_source, sizes, goals)]
    info = spark.createDataFrame(info, "_src string, _source_size long, _target double, _shards long")
    join = lambda a, b, on, n: a.join(F.broadcast(b) if n <= 100_000 else b, on, "left")
    spread = F.when(F.col("_id").isNull(), F.xxhash64(F.lit(seed + 1), "_size", "_rid")).otherwise(F.xxhash64(F.lit(seed + 1), "_id"))
    dealt = cut(join(slim, info, "_src", len(sizes)).withColumn("_shard", F.pmod(spread, F.col("_shards"))).drop("_shards"))
    cells = sorted(((r["_src"], r["_shard"], r["n"]) for r in dealt.groupBy("_src", "_shard").agg(F.sum("_size").alias("n")).where("n > 0").collect()))
    per = {r[2]: (n, g, i) for i, (r, n, g) in enumerate(zip(by_source, sizes, goals))}
    want = [per[s][1] * n / per[s][0] for s, _, n in cells]
    quotas = sainte_lague(want, round(sum(want) / block))
    plan = []
    for (s, k, n), q in zip(cells, quotas):
        blocks = max(1, round(n / block))
        # Quotas count nominal blocks; a cell's own blocks differ from them by less than a word each.
        q = min(MAX_REPEAT * blocks, round(q * block * blocks / n))
        step = 1 + _seeded(seed, per[s][2], k) % blocks
        while math.gcd(step, blocks) != 1:
            step += 1
        plan.append((s, k, int(n), blocks, int(q // blocks), int(q % blocks), step, _seeded(seed + 1, per[s][2], k) % blocks))
    plan = spark.createDataFrame(plan, "_src string, _shard long, _n long, _blocks long, _every long, _more long, _step long, _at long")
    w = Window.partitionBy("_src", "_shard").orderBy(F.xxhash64(F.lit(seed), "_id", "_size"), "_id", "_size", "_rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = join(dealt, plan, ["_src", "_shard"], len(cells)).withColumn("_end", F.sum("_size").over(w))
    edge = lambda j: _div(j * F.col("_n"), F.col("_blocks"))
    start = F.col("_end") - F.col("_size")
    first = _div(start * F.col("_blocks"), F.col("_n"))
    last = F.least(_div((F.col("_end") - 1) * F.col("_blocks"), F.col("_n")) + 1, F.col("_blocks") - 1)
    overlap = lambda j: F.greatest(F.lit(0).cast("long"), F.least(F.col("_end"), edge(j + 1)) - F.greatest(start, edge(j)))
    chosen = lambda j: F.pmod(j * F.col("_step") + F.col("_at"), F.col("_blocks")) < F.col("_more")
    extra = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda s, j: s + F.when(chosen(j), overlap(j)).otherwise(F.lit(0).cast("long")))
    taken = F.when((F.col("_size") == 0) | F.col("_n").isNull(), F.lit(0).cast("long")).otherwise(F.col("_every") * F.col("_size") + extra)
    placed = placed.withColumn("_taken", taken)
    share = _div(F.col("_taken") * 1_000_000, F.greatest("_size", F.lit(1)))
    return placed.withColumn("_before", F.sum(share).over(w) - share).withColumn("_share", share), dealt


def _sized(docs: DataFrame, columns, text: str, source: str, doc_id: str) -> DataFrame:
    src = F.coalesce(F.concat(F.lit("="), F.col(quoted(source)).cast("string")), F.lit("null"))
    return cut(docs.select(boxed(docs, columns), n_words(F.col(quoted(text))).alias("_size"), src.alias("_src"), F.col(quoted(doc_id)).alias("_id"), F.monotonically_increasing_id().alias("_rid")))


def mix(docs: DataFrame, weights=WEIGHTS, seed: int = 42, text: str = "text", source: str = "source", doc_id: str = "doc_id", keep=None) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, default all) with size, source_size, target and taken.

    Ids, sizes and sources alone are dealt and sorted; texts, where kept, join once at the end.
    """
    keep = docs.columns if keep is None else keep
    sized = _sized(docs, keep, text, source, doc_id)
    slim = sized if text not in keep else sized.drop("_row")
    out, _ = _taken(slim, weights, seed)
    if text in keep:
        out = out.join(sized.select("_rid", "_row"), "_rid")
    return out.select(*unboxed(keep, ("size", F.col("_size")), ("source_size", F.col("_source_size")), ("target", F.col("_target")), ("taken", F.col("_taken"))))


def resample(docs: DataFrame, weights=WEIGHTS, seed: int = 42, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mix as documents, columns as given: a row stays taken / size times.

    Broken parts are rounded by systematic sampling along the seeded order of each cell, so a cell's number of rows is
    within one of the sum of its shares, whatever ids repeat.
    """
    sized = _sized(docs, docs.columns, text, source, doc_id)
    placed, dealt = _taken(sized.drop("_row"), weights, seed)
    draw = F.pmod(F.xxhash64(F.lit(seed + 2), "_src", "_shard"), F.lit(1_000_000))
    upto = lambda x: _div(x + draw, F.lit(1_000_000))
    times = cut(placed.select("_rid", (upto(F.col("_before") + F.col("_share")) - upto(F.col("_before"))).cast("int").alias("_times")).where("_times > 0"))
    discard(dealt)
    out = sized.select("_rid", "_row").join(times.hint("shuffle_hash"), "_rid")
    return out.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_times"))).alias("_i")).select(*unboxed(docs.columns))
