"""SimHash near-dedup by binary trie self-joins, verified by exact shingle similarity.

A text is the set of its five-word shingles (ASCII lower case; a shorter text is one shingle). Rows are near copies where
the Jaccard similarity of their sets is ``least`` or more, and groups are the connected components of that relation.

A set has a SimHash of 2 816 majority bits, for one 64-bit fingerprint reaches 0.8 only at a radius that leaves a trie
nothing to prune. The bits are 96 codes of 28 and a tail of 128. The codes of each place form a binary trie that is joined
with itself: node pairs go down together and a pair over 2 differing bits is pruned; the tail has a budget of its own, 45.
Two sets of similarity 0.8 differ in a bit with a chance of 0.1515 (at most 0.162 for sets of 6 shingles and more), so all
tries miss them with a chance of 1e-8 (2e-7). Sets of 4 and 5 shingles meet exactly, by the sets that lack one. Every
candidate is then verified on the sets themselves, so no pair below ``least`` links. Equal sets are one node from the start.

Beyond ``cell`` sets a trie is dealt into cells by 3 blocks of its codes, of which 2 differing bits leave one equal. The
linked codes of a trie or cell are a bucket. Buckets are compared as stars first: a bucket of two is
decided then. Larger ones are merged where they overlap; one whose members are one component needs no more pairs, in the
others all pairs of different components are compared, by an inverted index inside the bucket, so pairs are never rows. A bucket of more than ``PART`` members is dealt into parts, and each two parts meet in a
task of their own: no task holds more than two parts of a bucket, and the work of one bucket spreads over the cluster. Null,
empty and blank texts have the empty set and are copies of each other.
"""

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, cut, quoted, small_batches, unboxed
from .simhash import components

WORDS = 5
#: Codes of a SimHash, their bits and differing bits, the bits of the tail and theirs.
CODES, BITS, RADIUS, TAIL, FAR = 96, 28, 2, 128, 45
PART, CELL = 2000, 1_000_000
_XOR = np.random.default_rng(42).integers(0, 1 << 63, (TAIL + CODES * BITS) // 64, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: A byte's bits as eight bytes, so that the bits of many rows add up byte by byte.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
_PLACE = np.int32(1) << np.arange(BITS, dtype=np.int32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    w, h64 = (text or "").encode("utf-8", "surrogatepass").lower().split(), xxhash.xxh64_intdigest
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter((h64(x, 42) for x in w), np.uint64, len(w))
    k = min(words, len(w))
    out = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * _STEP + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def simhash(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tail, codes) of a shingle set: bits that are set in more than half of the shingles' hashes."""
    ones = np.zeros(64 * len(_XOR), np.int64)
    for at in range(0, len(s), 255):
        ones += _SPREAD[_mix(s[at : at + 255, None] * _STEP ^ _XOR).view(np.uint8)].sum(0).view(np.uint8)
    bits = 2 * ones > len(s)
    return np.packbits(bits[:TAIL]).view("uint64"), bits[TAIL:].reshape(CODES, BITS) @ _PLACE


def lacking(s: np.ndarray) -> list[int]:
    """Keys by which sets of 4 shingles meet the sets of 5 that hold them."""
    sets = [s] if len(s) == 4 else [np.delete(s, i) for i in range(5)] if len(s) == 5 else []
    return [xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in sets]


_SKETCH = T.StructType().add("digest", T.StringType())
for _name in ("size", "tail_a", "tail_b"):
    _SKETCH.add(_name, T.LongType())
_SKETCH.add("codes", T.ArrayType(T.IntegerType())).add("lacking", T.ArrayType(T.LongType()))


@F.pandas_udf(_SKETCH)
def _sketch(text: pd.Series) -> pd.DataFrame:
    out = []
    for t in text:
        s = shingles(t)
        tail, codes = simhash(s)
        out.append((xxhash.xxh3_128_hexdigest(s.tobytes()), len(s), *tail.view("int64").tolist(), codes.tolist(), lacking(s)))
    return pd.DataFrame(out, columns=_SKETCH.names)


def trie_groups(codes: np.ndarray, tails: np.ndarray, leaf: int = 4, chunk: int = 1 << 18) -> np.ndarray:
    """The group of each code: components of the links with at most ``RADIUS`` bits of the code and ``FAR`` of the unsigned tail differing.

    The trie over the sorted codes is joined with itself, nodes are ranges. Small nodes and whole codes are compared member
    by member. Work is a stack of frontiers, split at ``chunk`` node pairs, so memory stays bounded.
    """
    order = np.argsort(codes, kind="stable")
    codes, tails, n = codes[order], tails[order], len(codes)
    parent = np.arange(n)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def unite(a, b):
        fresh = parent[a] != parent[b]
        for i, j in zip(a[fresh].tolist(), b[fresh].tolist()):
            i, j = root(i), root(j)
            if i != j:
                parent[max(i, j)] = min(i, j)

    def close(a, b):
        return np.bitwise_count(tails[a] ^ tails[b]).sum(-1, dtype=np.int64) <= FAR

    def crowd(a, b):
        """Two crowded nodes: members are compared only with those of other groups."""
        both = np.concatenate([a, b])
        label = np.array([root(i) for i in both.tolist()])
        for i in range(len(a)):
            rest = np.flatnonzero(label[len(a) :] != label[i]) + len(a)
            near = rest[close(a[i], both[rest])]
            if len(near):
                unite(np.full(len(near), a[i]), both[near])
                label[np.isin(label, label[near])] = label[i]
            if not len(rest) and (label == label[0]).all():
                return

    def compare(al, ah, bl, bh):
        wide = (ah - al) * (bh - bl)
        for i in np.flatnonzero(wide > chunk).tolist():
            crowd(np.arange(al[i], ah[i]), np.arange(bl[i], bh[i]))
        al, ah, bl, bh, wide = (x[wide <= chunk] for x in (al, ah, bl, bh, wide))
        ends = np.cumsum(wide)
        at = 0
        while at < len(al):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * chunk, "right")))
            w, across = wide[at:to], np.repeat(bh[at:to] - bl[at:to], wide[at:to])
            k = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            i, j = np.repeat(al[at:to], w) + k // across, np.repeat(bl[at:to], w) + k % across
            near = (i < j) & (np.bitwise_count(codes[i] ^ codes[j]) <= RADIUS)
            i, j = i[near], j[near]
            near = close(i, j)
            unite(i[near], j[near])
            at = to

    stack = [(0, *(np.array([x], np.int64) for x in (0, n, 0, n, 0)))] if n > 1 else []
    while stack:
        depth, al, ah, bl, bh, err = stack.pop()
        if len(al) > chunk:
            mid = len(al) // 2
            stack += [(depth, *(x[:mid] for x in (al, ah, bl, bh, err))), (depth, *(x[mid:] for x in (al, ah, bl, bh, err)))]
            continue
        done = (ah - al <= leaf) & (bh - bl <= leaf) if depth < BITS else np.ones(len(al), bool)
        if done.any():
            compare(al[done], ah[done], bl[done], bh[done])
            al, ah, bl, bh, err = (x[~done] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        ends = np.concatenate([[0], np.cumsum(codes >> (BITS - 1 - depth) & 1)])
        am, bm = ah - (ends[ah] - ends[al]), bh - (ends[bh] - ends[bl])
        twin = al == bl  # a node with itself: take the mixed pair once
        out = []
        for x, y, z, w, add, ok in ((al, am, bl, bm, 0, None), (am, ah, bm, bh, 0, None), (al, am, bm, bh, 1, None), (am, ah, bl, bm, 1, ~twin)):
            live = (y > x) & (w > z) & (err + add <= RADIUS) & ~((x == z) & (y - x == 1))
            live = live if ok is None else live & ok
            out.append((x[live], y[live], z[live], w[live], err[live] + add))
        stack.append((depth + 1, *(np.concatenate(p) for p in zip(*out))))
    while (parent[parent] != parent).any():
        parent = parent[parent]
    out = np.empty(n, np.int64)
    out[order] = parent
    return out


def buckets(nodes: DataFrame, cell: int = CELL) -> DataFrame:
    """_root, _fp, _of: each member of a bucket but its smallest, that smallest, and the bucket's size. ``nodes``: _fp and the sketch's columns."""
    codes = nodes.where("size > 0").select("_fp", "tail_a", "tail_b", F.posexplode("codes").alias("_k", "_code"))
    if nodes.count() > cell:
        block = [(F.lit(0), F.shiftright("_code", 19)), (F.lit(1), F.shiftright("_code", 10).bitwiseAND(F.lit(511))), (F.lit(2), F.col("_code").bitwiseAND(F.lit(1023)))]
        at = F.explode(F.array(*[(F.col("_k") * 3 + i) * 1024 + v for i, v in block]))
        codes = codes.select("_fp", "tail_a", "tail_b", at.alias("_k"), "_code")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = trie_groups(pdf["_code"].to_numpy("int64"), pdf[["tail_a", "tail_b"]].to_numpy("int64").view("uint64"))
        _, group, count = np.unique(groups, return_inverse=True, return_counts=True)
        fp, first = pdf["_fp"].to_numpy("int64"), np.full(len(count), np.iinfo(np.int64).max)
        np.minimum.at(first, group, fp)
        rest = first[group] != fp
        return pd.DataFrame({"_root": first[group][rest], "_fp": fp[rest], "_of": count[group][rest]})

    found = codes.groupBy("_k").applyInPandas(join, "_root long, _fp long, _of long")
    few = cut(nodes.where("size IN (4, 5)").select("_fp", F.explode("lacking").alias("_key")))
    least = few.groupBy("_key").agg(F.min("_fp").alias("_root"), F.count(F.lit(1)).alias("_of"))
    few = few.join(least, "_key").where("_root <> _fp").select("_root", "_fp", "_of")
    return found.unionByName(few)


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    last, s = None, None
    out = []
    for x, y in zip(a, b):
        if s is None or x != last:
            last, s = x, shingles(x)
        out.append(similarity(s, shingles(y)))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.BinaryType())
def _set(text: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).tobytes() for t in text], dtype="object")


def forest(ids: list, label: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple]:
    """Edges that join the members of a bucket with different labels whose similarity is ``least`` or more."""
    m, size, label = len(ids), np.array([len(s) for s in sets]), np.array(label)
    _, run = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), size)[np.argsort(run, kind="stable")]
    ends, at = np.concatenate([[0], np.cumsum(np.bincount(run))]), np.concatenate([[0], np.cumsum(size)])
    out, step = [], max(1, (1 << 22) // m)
    for i in range(m):
        if (label[i:] == label[i]).all():
            continue
        both = np.zeros(m, np.int64)
        for k in range(at[i], at[i + 1], step):
            r = run[k : min(k + step, at[i + 1])]
            n = ends[r + 1] - ends[r]
            both += np.bincount(owner[np.repeat(ends[r] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=m)
        near = both >= least * (size[i] + size - both)
        for j in np.flatnonzero(near).tolist():
            if label[j] != label[i]:
                out.append((ids[j], ids[i]))
                label[label == label[j]] = label[i]
    return out


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` with an _fp of ``ids``, written; up to a million ids (8 MB) are broadcast, more are shuffled."""
    ids = cut(ids)
    return cut(texts.join(F.broadcast(ids) if ids.count() <= 1_000_000 else ids, "_fp", "left_semi"))


def dedup(docs: DataFrame, least: float = 0.8, text: str = "text", doc_id: str = "doc_id", part: int = PART, cell: int = CELL) -> DataFrame:
    """One row of each group of near copies, that with the smallest doc_id; columns as given."""
    small_batches(docs.sparkSession)
    body, own = F.col(f"_row.{quoted(text)}"), F.col(f"_row.{quoted(doc_id)}")
    marked = docs.select(boxed(docs), F.monotonically_increasing_id().alias("_rid"), _sketch(F.col(quoted(text))).alias("_s"))
    marked = cut(marked)
    key = F.struct(own.isNull().alias("a"), own.alias("b"), F.col("_rid").alias("c"))
    kept = marked.select(key.alias("_key"), "_s").groupBy("_s.digest").agg(F.min(F.struct("_key", "_s")).alias("_m"))
    nodes = cut(kept.select(F.col("_m._key.c").alias("_fp"), "_m._key", "_m._s.*"))
    texts = marked.select(F.col("_rid").alias("_fp"), body.alias("_text"))
    stars = cut(buckets(nodes, cell).groupBy("_root", "_fp").agg(F.max("_of").alias("_of")))
    labels = nodes.select("_fp", F.col("_key").alias("_label"))
    # Stars first: the smallest member of a bucket against the others.
    sizes = nodes.select("_fp", F.col("size").alias("_n"))
    pairs = stars.join(sizes, "_fp").join(sizes.select(F.col("_fp").alias("_root"), F.col("_n").alias("_m")), "_root")
    pairs = cut(pairs.where(F.least("_n", "_m") >= F.lit(least) * F.greatest("_n", "_m") - 1e-9).select("_root", "_fp"))
    # Only texts of candidates move.
    texts = _only(texts, stars.select("_fp").unionByName(stars.select(F.col("_root").alias("_fp"))).distinct())
    sides = pairs.join(texts, "_fp").join(texts.select(F.col("_fp").alias("_root"), F.col("_text").alias("_first")), "_root")
    edges = cut(sides.where(_similarity("_first", "_text") >= least).select("_fp", "_root"))
    if not edges.isEmpty():
        labels = cut(components(nodes.select("_fp", "_key"), edges))
    # A star has decided a bucket of two. The others are one where they overlap.
    links = cut(stars.where("_of > 2").select("_fp", "_root"))
    members = cut(links.select("_fp").unionByName(links.select(F.col("_root").alias("_fp"))).distinct().withColumn("_key", F.col("_fp")))
    rows = components(members, links).select("_fp", F.col("_label").alias("_b")).join(labels.select("_fp", F.col("_label.c").alias("_label")), "_fp")
    # Buckets that are not one component yet: every pair of components, inside the bucket.
    opened = rows.groupBy("_b").agg((F.min("_label") != F.max("_label")).alias("_open"), F.ceil(F.count(F.lit(1)) / part).alias("_parts")).where("_open").drop("_open")
    rows = rows.join(opened, "_b").withColumn("_i", F.pmod(F.xxhash64("_fp"), F.col("_parts")))
    # Members of a whole bucket meet once, a part meets each other part.
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1), lambda j: (j != F.col("_i")) | (F.col("_parts") == 1))
    rows = rows.withColumn("_j", F.explode(others))
    rows = cut(rows.select("_b", F.least("_i", "_j").alias("_i"), F.greatest("_i", "_j").alias("_j"), "_fp", "_label"))
    n = rows.count()
    if n:
        sets = rows.select("_fp").distinct().join(texts, "_fp").select("_fp", _set("_text").alias("_set"))
        dealt = rows.join(cut(sets), "_fp").withColumn("_g", F.pmod(F.xxhash64("_b", "_i", "_j"), F.lit(max(64, n // 2000))))

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for _, met in pdf.groupby(["_b", "_i", "_j"]):
                out += forest(met["_fp"].tolist(), met["_label"].to_numpy(), [np.frombuffer(x, np.uint64) for x in met["_set"]], least)
            return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["_fp", "_root"])

        more = cut(dealt.groupBy("_g").applyInPandas(compare, "_fp long, _root long").distinct())
        if not more.isEmpty():
            labels = cut(components(nodes.select("_fp", "_key"), edges.unionByName(more)))
    first = labels.where("_label.c = _fp").select(F.col("_fp").alias("_rid"))
    return marked.join(first, "_rid", "left_semi").select(*unboxed(docs.columns))
