"""Approximate nearest neighbours by multi-index hashing.

Binary codes come from learned rotations (iterative quantisation on a bounded sample). A code is split into substrings,
each indexed by its value. Two codes within Hamming radius r agree in some substring up to r // substrings bits, so probing
every value that near retrieves every code within the radius; those are reranked by inner products in double precision.

Nearness is the inner product, so vectors are first lifted to one length: rows gain a coordinate sqrt(M^2 - |x|^2), M the
greatest length, and queries a zero. Near in angle is then near in inner product, whatever the lengths.

The index is laid out in blocks of at most some ``block`` rows, and blocks of queries meet each of them once; their numbers
follow the rows alone. Per query and block the radius is the smallest that reaches ``share`` of the block (at least k codes).
A query is a row: its own row is left out, another row of the same id is a candidate, and each row of a repeated query id
gets its own list. Vectors that are null, zero, of another dimension than the most common one, or that hold null or
non-finite components take no part; null ids sort after all others. Ties go to the smaller id. An empty table gives an
empty result, and columns beside id and vector are not read.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, quoted

SAMPLE, ROTATIONS, SUBSTRING = 8192, 4, 8
BLOCK, QUERY_BLOCK, SHARE = 8192, 2048, 0.15
LAST = (1 << 63) - 1
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def valid(df: DataFrame, vector: str = "embedding") -> DataFrame:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0))


def learn(sample: np.ndarray, rotations: int = ROTATIONS, rounds: int = 25, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimension x bits): principal axes turned by ``rotations`` learned rotations."""
    mean = sample.mean(0)
    z = sample - mean
    axes = np.linalg.eigh(z.T @ z + 1e-9 * np.eye(z.shape[1]))[1]
    v, out, rng = z @ axes, [], np.random.default_rng(seed)
    for _ in range(rotations):
        turn = np.linalg.qr(rng.standard_normal((v.shape[1],) * 2))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(v.T @ np.where(v @ turn > 0, 1.0, -1.0))
            turn = left @ right
        out.append(axes @ turn)
    return mean, np.hstack(out)


def encode(x: np.ndarray, model) -> np.ndarray:
    """Codes as bytes (n x substrings); bits beyond the last whole byte are zero for all."""
    return np.packbits((x - model[0]) @ model[1] > 0, axis=1)


def _packed(codes: np.ndarray) -> np.ndarray:
    """Codes as whole 64-bit words."""
    wide = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), np.uint8)
    wide[:, : codes.shape[1]] = codes
    return wide.view(np.uint64)


def probe(queries: np.ndarray, codes: np.ndarray, share: float, k: int):
    """Yield (query number, candidate numbers): every code within that query's radius.

    With radius r the probed values of each substring are those within r // substrings bits; what they retrieve is checked
    on its whole code. Few values are read from the substring's directory, many by a table over its values. The first radius
    tried is guessed from every 32nd code, and grows by whole probing steps until it holds the share.
    """
    n, m = codes.shape
    order = [np.argsort(codes[:, j], kind="stable") for j in range(m)]
    ends = [np.searchsorted(codes[order[j], j], np.arange(257)) for j in range(m)]
    columns, words, asked = np.ascontiguousarray(codes.T), _packed(codes), _packed(queries)
    want = min(n, max(k, int(np.ceil(share * n))))
    some, values = words[::32], np.arange(256)
    for i, q in enumerate(queries):
        guess = np.sort(np.bitwise_count(some ^ asked[i]).sum(1, dtype=np.int32))[min(len(some) - 1, want * len(some) // n)]
        step = min(8, max(0, -(-(int(guess) + 1) // m) - 1))
        while True:
            seen = np.zeros(n, bool)
            for j in range(m):
                near = _ONES[values ^ q[j]] <= step
                if step < 2:
                    for value in np.flatnonzero(near):
                        seen[order[j][ends[j][value] : ends[j][value + 1]]] = True
                else:
                    seen |= near[columns[j]]
                    if j & 3 == 3 and seen.all():
                        break
            found = np.flatnonzero(seen)
            dist = np.bitwise_count(words[found] ^ asked[i]).sum(1, dtype=np.int32)
            radius = m * (step + 1) - 1  # all codes this near have been retrieved
            if (dist <= radius).sum() >= want or step == 8:
                break
            step += 1
        limit = np.partition(dist, want - 1)[want - 1] if len(dist) >= want else radius
        yield i, found[dist <= limit]


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows of one length ``longest``, scaled to one; the added coordinate is what their length lacks."""
    x = x / longest
    return np.hstack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))[:, None]])


def ask(x: np.ndarray) -> np.ndarray:
    """Queries on the same sphere: only their direction counts."""
    return np.hstack([x / np.maximum(np.linalg.norm(x, axis=1), np.finfo(float).tiny)[:, None], np.zeros((len(x), 1))])


def search(vectors: DataFrame, queries, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row that the condition ``queries`` picks, its own left out."""
    spark = vectors.sparkSession
    own = F.coalesce(queries, F.lit(False)).alias("_ask")
    fine = valid(vectors.select(F.col(quoted(vec_id)).cast("long").alias("_id"), F.col(quoted(vector)).cast("array<double>").alias("_v"), own), "_v")
    rows = cut(fine.withColumn("_rid", F.monotonically_increasing_id()))
    out = "query_id long, _q_rid long, vec_id long, score double"
    dims = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("_v") == dims[0])
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    n, nq, longest = rows.agg(F.count(F.lit(1)), F.count_if("_ask"), F.max(length)).first()
    if not np.isfinite(longest):
        raise ValueError("a vector's length is beyond double precision")
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("_id", "_rid"), "_id", "_rid").select("_v").limit(SAMPLE).collect()])
    model = learn(lift(sample, longest))
    blocks, parts = max(1, -(-n // block)), max(1, -(-nq // QUERY_BLOCK))
    deal = lambda df, own, m, other, p: df.withColumn(own, F.pmod(F.xxhash64("_rid"), F.lit(m))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
    picked = lambda df: df.select(F.col("_q").cast("int"), F.col("_b").cast("int"), F.coalesce("_id", F.lit(LAST)).alias("_id"), "_rid", "_v")
    left = picked(deal(rows.where("_ask"), "_q", parts, "_b", blocks))
    right = picked(deal(rows, "_b", blocks, "_q", parts))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        kinds = {"query_id": "int64", "_q_rid": "int64", "vec_id": "int64", "score": "float64"}
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in kinds}).astype(kinds)
        qid, qrow, ids, row = a["_id"].to_numpy(), a["_rid"].to_numpy(), b["_id"].to_numpy(), b["_rid"].to_numpy()
        qv, v = np.stack(a["_v"].to_list()), np.stack(b["_v"].to_list())
        found = []
        for i, c in probe(encode(ask(qv), model), encode(lift(v, longest), model), share, k + 1):
            c = c[row[c] != qrow[i]]
            s = (v[c] * qv[i]).sum(1)
            if len(c) > k:
                best = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                c, s = c[best], s[best]
            top = np.lexsort((ids[c], -s))[:k]
            found += [(qid[i], qrow[i], ids[c[t]], s[t]) for t in top]
        return pd.DataFrame(found, columns=list(kinds)).astype(kinds)

    best = left.groupBy("_q", "_b").cogroup(right.groupBy("_q", "_b")).applyInPandas(meet, out)
    w = Window.partitionBy("query_id", "_q_rid").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.nullif("vec_id", F.lit(LAST)).alias("vec_id"), "score")
