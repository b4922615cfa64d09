"""SimHash near-dedup by a binary trie self-join.

Fingerprints: ASCII lower-cased words, 3-word shingles with repeats, XXH64 (seed 42), majority bits. Distinct
fingerprints are linked when at most ``radius`` bits differ. At most 3 differing bits over 4 blocks of 16 leave one block
equal, so each fingerprint goes to 4 (block, value) cells; a cell with more than ``cell`` fingerprints is dealt again by 4
parts of its remaining bits, as often as needed. In a cell, a binary trie over the bits is joined with itself: node pairs
go down together, differing bits add up, and a pair over the budget is pruned. Each cell gives a spanning forest of its
links, not the pairs; components follow by alternating large-star and small-star steps.

Null, empty and blank texts have fingerprint zero and link like any other; very long texts are read whole; equal texts are
one fingerprint from the start; null ids sort last. An empty table gives an empty result.
"""

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, cut, discard, quoted, small_batches, unboxed

HEX = "fingerprint"


def fingerprint(text) -> int:
    """The 64-bit SimHash of a whole text; zero where there is no word."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    shingles = [b" ".join(s) for s in zip(w, w[1:], w[2:])] if len(w) > 2 else [b" ".join(w)]
    ones, h64 = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(shingles), 8192):
        h = np.array([h64(s, 42) for s in shingles[at : at + 8192]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in text], dtype="uint64").astype("int64") if len(text) else pd.Series([], dtype="int64")


def trie_forest(codes: np.ndarray, radius: int, chunk: int = 1 << 20) -> list[tuple[int, int]]:
    """Spanning forest, as (code, root), of the links among distinct uint64 ``codes``: the trie joined with itself.

    Nodes are ranges of the sorted codes. Work is a stack of frontiers of node pairs, split at ``chunk`` pairs, so memory
    stays bounded however many pairs the budget lets through.
    """
    codes = np.sort(codes)
    parent = np.arange(len(codes))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def unite(a, b):
        # Components of a star first: most pairs of a frontier are already united.
        fresh = parent[a] != parent[b]
        for i, j in zip(a[fresh].tolist(), b[fresh].tolist()):
            i, j = root(i), root(j)
            if i != j:
                parent[max(i, j)] = min(i, j)

    n = len(codes)
    # Bits on which all codes agree need no step down.
    spread = int(np.bitwise_or.reduce(codes ^ codes[0])) if n else 0
    bits = [b for b in range(63, -1, -1) if spread >> b & 1]
    stack = [(0, *(np.array([x], np.int64) for x in (0, n, 0, n, 0)))] if n > 1 else []
    while stack:
        depth, al, ah, bl, bh, err = stack.pop()
        if len(al) > chunk:
            mid = len(al) // 2
            stack += [(depth, *(x[:mid] for x in (al, ah, bl, bh, err))), (depth, *(x[mid:] for x in (al, ah, bl, bh, err)))]
            continue
        if depth == len(bits):
            off = al != bl
            unite(al[off], bl[off])
            continue
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():  # two leaves: the rest of the path is one comparison
            a, b = al[single], bl[single]
            near = (a != b) & (np.bitwise_count(codes[a] ^ codes[b]) <= radius)
            unite(a[near], b[near])
            al, ah, bl, bh, err = (x[~single] for x in (al, ah, bl, bh, err))
            if not len(al):
                continue
        one = ((codes >> np.uint64(bits[depth])) & np.uint64(1)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(one)])
        am, bm = ah - (ends[ah] - ends[al]), bh - (ends[bh] - ends[bl])
        twin = al == bl  # a node with itself: take the mixed pair once
        out = []
        for x, y, z, w, add, ok in ((al, am, bl, bm, 0, None), (am, ah, bm, bh, 0, None), (al, am, bm, bh, 1, None), (am, ah, bl, bm, 1, ~twin)):
            live = (y > x) & (w > z) & (err + add <= radius) & ~((x == z) & (y - x == 1))
            live = live if ok is None else live & ok
            out.append((x[live], y[live], z[live], w[live], err[live] + add))
        stack.append((depth + 1, *(np.concatenate(p) for p in zip(*out))))
    return [(int(codes[i]), int(codes[r])) for i in range(n) if (r := root(i)) != i]


def _cells(fps: DataFrame, key, used: int, parts: int, width: int) -> DataFrame:
    """One row per part: the key grows by the part's number and bits. ``used`` bits are rotated out of the way already."""
    exploded = fps.withColumn("_part", F.explode(F.array(*[F.lit(i) for i in range(parts)])))
    left = 64 - used
    # The rotated remaining bits live in the low ``left`` bits; a part is cut out and the others close up.
    shift = F.col("_part") * width
    rest = F.col("_rest")
    value = F.call_function("shiftrightunsigned", rest, shift.cast("int")).bitwiseAND(F.lit((1 << width) - 1))
    below = F.expr("shiftleft(1L, cast(_part * {0} as int)) - 1".format(width)).bitwiseAND(rest)
    above = F.when(shift + width >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.call_function("shiftrightunsigned", rest, F.least(shift + width, F.lit(63)).cast("int")), shift.cast("int")))
    return exploded.select("_fp", F.concat_ws(":", key, F.col("_part").cast("string"), F.hex(value)).alias("_key"), above.bitwiseOR(below).alias("_rest"))


def links(fps: DataFrame, radius: int = 3, cell: int = 20_000) -> DataFrame:
    """Edges (_fp, _root) whose components are those of all fingerprints within ``radius`` bits. ``fps``: distinct _fp."""
    if radius != 3:
        raise ValueError("the block scheme is laid out for three differing bits")
    level = _cells(fps.withColumn("_rest", F.col("_fp")), F.lit("c"), 0, 4, 16)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = trie_forest(np.unique(pdf["_fp"].to_numpy("int64").view("uint64")), radius)
        return pd.DataFrame(np.array(pairs, dtype="uint64").reshape(-1, 2).view("int64"), columns=["_fp", "_root"])

    edges = None
    # 16, then 12, 9 and 6 more equal bits: a fully dealt cell shares 43 bits.
    for used, width in ((16, 12), (28, 9), (37, 6), (43, 0)):
        level = cut(level)
        heavy = level.groupBy("_key").count().where(F.col("count") > cell).select("_key")
        heavy = cut(heavy)
        last = not width or heavy.isEmpty()
        light = level if last else level.join(heavy, "_key", "left_anti")
        # Most cells hold a few codes: cells share buckets, and one trie serves a whole bucket.
        found = light.select(F.pmod(F.xxhash64("_key"), F.lit(max(64, level.count() // 4000))).alias("_b"), "_fp").groupBy("_b").applyInPandas(join, "_fp long, _root long")
        edges = found if edges is None else edges.unionByName(found)
        if last:
            return edges.distinct()
        level = _cells(level.join(heavy, "_key", "left_semi"), F.col("_key"), used, 4, width)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_fp", "_root").cast("decimal(38,0)"))).first())


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(_fp, _label): the smallest _key of each component. ``nodes``: _fp, _key; ``edges``: _fp, _root.

    Large-star and small-star steps alternate until the edges are stars: every node hangs its neighbours on the smallest node
    it knows, which shortens long chains by half a step, so rounds grow with the logarithm of the chain. Each round is a
    combined aggregation and joins, never a collected neighbourhood.
    """
    lower = lambda e: e.select(F.greatest("_fp", "_root").alias("_fp"), F.least("_fp", "_root").alias("_root")).where("_fp <> _root").distinct()
    edges = cut(lower(edges))
    if edges.isEmpty():
        return nodes.select("_fp", F.col("_key").alias("_label"))
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("_root").alias("_fp"), F.col("_fp").alias("_root")))
        least = both.groupBy("_fp").agg(F.min("_root").alias("_m")).select("_fp", F.least("_fp", "_m").alias("_m"))
        # Large star: greater neighbours go to the smallest of the neighbourhood.
        up = both.where("_root > _fp").join(least, "_fp").select(F.col("_root").alias("_fp"), F.col("_m").alias("_root"))
        large = cut(lower(up))
        # Small star: lesser neighbours and the node itself go to the smallest of them.
        first = large.groupBy("_fp").agg(F.min("_root").alias("_m"))
        down = large.join(first, "_fp").select(F.col("_root").alias("_fp"), F.col("_m").alias("_root"))
        after = cut(lower(down.unionByName(first.select("_fp", F.col("_m").alias("_root")))))
        discard(edges, large)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    # Stars now: each node hangs on the smallest node of its component.
    hung = nodes.join(edges, "_fp", "left").select("_fp", "_key", F.coalesce("_root", "_fp").alias("_root"))
    labels = hung.groupBy("_root").agg(F.min("_key").alias("_label"))
    return hung.join(labels, "_root").select("_fp", "_label")


def _classes(docs: DataFrame, radius: int, text: str, doc_id: str, keep) -> DataFrame:
    """_row, _fp, _key and _label: the caller's columns, the fingerprint, the row's key and the smallest key of its component.

    A row key is struct(id is null, id, row number), so null and repeated ids have a defined order.
    """
    small_batches(docs.sparkSession)
    marked = docs.select(boxed(docs, keep), F.col(quoted(doc_id)).alias("_id"), _fingerprints(F.col(quoted(text))).alias("_fp"), F.monotonically_increasing_id().alias("_rid"))
    marked = cut(marked).select("_row", "_fp", F.struct(F.col("_id").isNull().alias("a"), F.col("_id").alias("b"), F.col("_rid").alias("c")).alias("_key"))
    nodes = cut(marked.groupBy("_fp").agg(F.min("_key").alias("_key"), F.count(F.lit(1)).alias("_n")))
    total = nodes.agg(F.sum("_n")).first()[0] or 0
    labels = cut(components(nodes.select("_fp", "_key"), links(nodes.select("_fp"), radius)))
    # Fingerprints with over a five-hundredth of the rows: at most 500, told apart by a list and joined by broadcast.
    hot = [r[0] for r in nodes.where(F.col("_n") > max(64, total // 500)).select("_fp").collect()]
    warm, cold = F.col("_fp").isin(hot) if hot else F.lit(False), ~F.col("_fp").isin(hot) if hot else F.lit(True)
    return marked.where(cold).join(labels.where(cold), "_fp").unionByName(marked.where(warm).join(F.broadcast(labels.where(warm)), "_fp"))


def classes(docs: DataFrame, radius: int = 3, text: str = "text", doc_id: str = "doc_id", keep=None) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, default all) with ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest doc_id of the component, null where all its ids are. Own columns of these names are replaced.
    """
    keep = docs.columns if keep is None else keep
    digits = F.lower(F.lpad(F.hex("_fp"), 16, "0"))
    return _classes(docs, radius, text, doc_id, keep).select(*unboxed(keep, (HEX, digits), ("component_id", F.col("_label.b"))))


def dedup(docs: DataFrame, radius: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component, that with the smallest doc_id; columns as given."""
    return _classes(docs, radius, text, doc_id, docs.columns).where(F.col("_key") == F.col("_label")).select(*unboxed(docs.columns))
