"""Best-fit packing by a configuration linear program.

Documents become pieces of at most ``capacity`` tokens. Over the histogram of piece lengths (at most ``capacity``
entries), the configuration LP is solved by multiplicative weights: each round prices lengths, and an unbounded knapsack
dynamic programme finds the best configuration, until every length's need is covered. The fractional solution is rounded
down, and what the rounding leaves is packed by best fit over the histogram. Pieces then find their place by their rank among pieces of their length.

Null texts are empty and hold the end token alone. Repeated rows are packed each on its own. An empty table gives an
empty result. The driver holds the histogram and the configurations, both bounded by ``capacity``.
"""

import json
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small_batches

CAPACITY, END = 1024, 2
SPECIAL = "<|endoftext|>"


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable characters; others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """text -> ids, as ``tokenizers`` gives them for the file, run by the quicker byte-pair library where both agree."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow, byte = Tokenizer.from_file(path), _byte_of()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t != SPECIAL}
    quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: slow.encode(t, add_special_tokens=False).ids if SPECIAL in t else quick.encode_ordinary(t)


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones, after a first one that may be shorter."""
    head = n % capacity or capacity
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> list[int]:
    """The multiset of lengths with the highest price within ``capacity`` (unbounded knapsack), as indices."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        k = np.searchsorted(lengths, c, side="right")
        best[c] = best[c - 1]
        if k:
            v = prices[:k] + best[c - lengths[:k]]
            i = int(v.argmax())
            if v[i] > best[c]:
                best[c], pick[c] = v[i], i
    out, c = [], capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out.append(int(pick[c]))
            c -= int(lengths[pick[c]])
    return out


def _fill(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, on the histogram: each pattern is used as often as its counts allow."""
    left, out = dict(counts), []
    while left:
        room, pattern = capacity, {}
        for n in sorted(left, reverse=True):
            if n <= room and (k := min(left[n], room // n)):
                pattern[n] = k
                room -= k * n
        times = min(left[n] // k for n, k in pattern.items())
        out.append((pattern, times))
        for n, k in pattern.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def relax(lengths: np.ndarray, need: np.ndarray, capacity: int = CAPACITY) -> dict[tuple[int, ...], float]:
    """Configuration (indices of lengths, with repeats) -> fractional uses; together they cover every length's need exactly."""
    used, seen = np.zeros(len(lengths)), {}
    # Each round covers a length or a part of its need; fewer lengths get finer parts. Prices grow faster than lengths, as
    # short lengths are easier to place in the end.
    parts = min(8, max(2, 2048 // len(lengths)))
    while len(open_ := np.flatnonzero(used < need)):
        prices = (lengths / capacity) ** 2 * np.exp(-0.2 * np.clip(used / need - used.sum() / need.sum(), -20, 20))
        chosen = tuple(int(open_[i]) for i in knapsack(prices[open_], lengths[open_], capacity))
        ids, copies = np.unique(chosen, return_counts=True)
        most = float(((need - used)[ids] / copies).min())
        step = min(most, float((need[ids] / copies).min()) / parts)
        seen[chosen] = seen.get(chosen, 0.0) + step
        used[ids] += step * copies
        full = ids[need[ids] - used[ids] <= 1e-9 * need[ids]]
        used[full] = need[full]
    return seen


def configure(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Configurations (length -> copies) and how many sequences use each; together they place every piece exactly."""
    if not counts:
        return []
    lengths = np.array(sorted(counts))
    seen = relax(lengths, np.array([counts[n] for n in lengths], float), capacity)
    left, plan = dict(counts), []
    for chosen, x in sorted(seen.items(), key=lambda kv: (-kv[1], kv[0])):
        ids, copies = np.unique(chosen, return_counts=True)
        pattern = {int(lengths[i]): int(k) for i, k in zip(ids, copies)}
        times = min(int(x + 1e-6), *(left[n] // k for n, k in pattern.items()))
        if times:
            plan.append((pattern, times))
            for n, k in pattern.items():
                left[n] -= k * times
    return plan + _fill({n: k for n, k in left.items() if k}, capacity)


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, sequences, offset, copies) in order of rank."""
    runs, rank, base = {}, {}, 0
    for pattern, times in plan:
        at = 0
        for n in sorted(pattern, reverse=True):
            k = pattern[n]
            runs.setdefault(n, []).append((rank.get(n, 0), base, times, at, k))
            rank[n] = rank.get(n, 0) + k * times
            at += k * n
        base += times
    return {n: np.array(r, np.int64) for n, r in runs.items()}


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32 and, on request, the ids themselves."""
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def run(batches):
        encode = encoder(path)
        for b in batches:
            rows = []
            for d, t in zip(b["_id"].tolist(), b["_text"].tolist()):
                ids = np.array([*encode(t or ""), END], dtype="<u4")
                for i, (s, n) in enumerate(cuts(len(ids), capacity)):
                    part = ids[s : s + n]
                    rows.append((d, i, s, n, zlib.crc32(part.tobytes()), *([part.tolist()] if keep_ids else [])))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            if kind in ("bigint", "int"):
                out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).mapInPandas(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = True, **columns) -> DataFrame:
    """Every piece with its sequence_id and offset; sequences have no gaps and at most ``capacity`` tokens."""
    spark = docs.sparkSession
    pieces = cut(tokenize(docs, path, capacity, keep_ids=keep_ids, **columns))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(slots(configure(counts, capacity)))
    # Ranks within a length come from ranks within its shards and the shards' counts: no length has to fit one task.
    shards = max(64, sum(counts.values()) // 200_000)
    mixed = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    mixed = cut(mixed)
    sizes = mixed.groupBy("length", "_shard").count()
    before = sizes.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("length", "_shard").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = mixed.withColumn("_rank", within - 1).join(before.select("length", "_shard", F.coalesce("_before", F.lit(0)).alias("_before")), ["length", "_shard"])
    ranked = ranked.withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("long"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), np.int64)
        n, r = length.to_numpy(), rank.to_numpy()
        for m in np.unique(n):
            at = np.flatnonzero(n == m)
            runs = places.value[int(m)]
            run = runs[np.searchsorted(runs[:, 0], r[at], side="right") - 1]
            k = r[at] - run[:, 0]
            out[at, 0], out[at, 1] = run[:, 1] + k % run[:, 2], run[:, 3] + k // run[:, 2] * m
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    return ranked.withColumn("_place", place("length", "_rank")).select(*pieces.columns, "_place.sequence_id", "_place.offset")
