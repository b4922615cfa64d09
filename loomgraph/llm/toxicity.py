"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on toxic and on ordinary text. A text is read in windows; a window's evidence is
how many bytes fewer it takes with the toxic dictionary than with the ordinary one. A window is one word between blanks:
an abusive word among ordinary ones is lost in the noise of longer windows. How many windows of a document pass each of
several thresholds, calibrated by a logistic curve on labelled rows, gives its score.

Labels mark documents, not windows. The samples for the toxic dictionary are therefore the stretches of toxic texts whose
byte n-grams stand there significantly more often than in ordinary texts (log-likelihood ratio over distinct contexts, so
that copies of a text are one witness); the ordinary dictionary is trained on whole ordinary texts. Calibration measures
each half of the training rows with dictionaries of the other half.

Training uses at most ``MAX_TRAIN`` labelled ids of a class, those of smallest hash. Null and empty texts have no windows
and get the calibrated score of no evidence; very long texts and words are read whole. Without rows of both classes every
score is 0. Rows repeat as given and equal texts get equal scores. An own column named ``score`` is replaced.
"""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, quoted, small_batches, unboxed

#: Training ids a class, toxic (1) and ordinary (0).
MAX_TRAIN = {1: 2500, 0: 4000}
THRESHOLD = 0.7
GRAM, LEAST_LLR, LEAST_LIFT = 6, 30.0, 10.0
PLAIN_BYTES, SEGMENT = 8 << 10, 16
STEPS, MEMO = (2, 3, 4, 5), 400_000
# A frame's last bytes are never matched and its first match pays the block's overhead: both dictionaries know both ends.
HEAD, TAIL = b"<0123456789abcdef> ", b" 0123456789"
STRIP = b".,;:!?|#$%&*\"'()[]<>"


def words(text) -> list[bytes]:
    return [x for x in (w.strip(STRIP) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()) if x]


def _all_words(texts: list[str], pool: dict[bytes, bytes]) -> list[list[bytes]]:
    """Words of each text, equal ones as one object: the driver holds each word once."""
    return [[pool.setdefault(w, w) for w in words(t)] for t in texts]


def _contexts(texts: list[list[bytes]]) -> Counter:
    """word -> number of distinct (word before, word after)."""
    ids, rows = {b"": 0}, []
    for w in texts:
        i = np.fromiter((ids.setdefault(x, len(ids)) for x in w), np.int32, len(w))
        if len(i):
            around = np.zeros((len(i), 3), np.int32)
            around[1:, 0], around[:, 1], around[:-1, 2] = i[:-1], i, i[1:]
            rows.append(np.unique(around, axis=0))
    if not rows:
        return Counter()
    rows = np.concatenate(rows)
    rows = rows[np.lexsort(rows.T)]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])
    count = np.bincount(rows[new, 1], minlength=len(ids))
    return Counter({w: int(count[i]) for w, i in ids.items() if count[i]})


def _grams(word: bytes) -> list[bytes]:
    w = b" " + word + b" "
    return [w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))]


def stretches(toxic: list[list[bytes]], plain: list[list[bytes]]) -> Counter:
    """Stretches of toxic words made of n-grams that mark toxic texts, with their numbers of contexts."""
    seen = [_contexts(plain), _contexts(toxic)]
    grams = [Counter(), Counter()]
    for c in (0, 1):
        for w, n in seen[c].items():
            for g in _grams(w):
                grams[c][g] += n
    n0, n1 = (max(1, s.total()) for s in seen)

    def marks(g, k):
        m = grams[0][g]
        if k / n1 <= LEAST_LIFT * (m + 1) / n0:
            return False
        return 2 * (k * math.log(k * (n0 + n1) / ((k + m) * n1)) + (m * math.log(m * (n0 + n1) / ((k + m) * n0)) if m else 0)) >= LEAST_LLR

    telling, out = {g for g, k in grams[1].items() if marks(g, k)}, Counter()
    for w, n in seen[1].items():
        at = [i for i, g in enumerate(_grams(w)) if g in telling]
        w, i = b" " + w + b" ", 0
        while i < len(at):
            j = i
            while j + 1 < len(at) and at[j + 1] - at[j] <= GRAM:
                j += 1
            out[w[at[i] : at[j] + GRAM]] += n
            i = j + 1
    return out


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    try:
        return zstd.train_dictionary(size, samples, k=SEGMENT, d=6, level=3).as_bytes()
    except zstd.ZstdError:
        return b"".join(sorted(set(samples)))[-size:]


def train_dicts(toxic: list[str], plain: list[str]) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionary of the labelled texts."""
    pool = {}
    toxic, plain = _all_words(toxic, pool), _all_words(plain, pool)
    del pool
    found = stretches(toxic, plain) or Counter(b" " + w + b" " for t in toxic for w in t)
    rows = [s for s, n in sorted(found.items()) for _ in range(min(n, 256))]
    rows = [rows[i] for i in np.random.default_rng(0).permutation(len(rows))]
    lines = [b" ".join([b"", *t[i : i + 8], b""]) for t in plain for i in range(0, len(t), 8)]
    del toxic, plain
    size = min(32 << 10, 512 + 4 * sum(map(len, found)))
    return _dictionary([b"".join(rows[i : i + 8]) for i in range(0, len(rows), 8)], size), _dictionary(lines, PLAIN_BYTES)


class Distance:
    """Evidence of windows: bytes saved by the toxic dictionary against the ordinary one."""

    def __init__(self, toxic: bytes, plain: bytes):
        # Raw content: literals then cost a byte each, and a match shows in whole bytes.
        how = zstd.ZstdCompressionParameters.from_level(16, min_match=3, window_log=16, hash_log=12, chain_log=12, search_log=4, write_content_size=0, write_dict_id=0)
        make = lambda d: zstd.ZstdCompressor(compression_params=how, dict_data=zstd.ZstdCompressionDict(d + HEAD + TAIL, dict_type=zstd.DICT_TYPE_RAWCONTENT))
        self.toxic, self.plain = make(toxic), make(plain)
        self.memo = {}

    @staticmethod
    def lengths(compressor, windows: list[bytes]) -> np.ndarray:
        size = np.fromiter(map(len, windows), np.uint64, len(windows))
        at = np.stack([np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.uint64), size], axis=1)
        out = compressor.multi_compress_to_buffer(zstd.BufferWithSegments(b"".join(windows), np.ascontiguousarray(at).tobytes()))
        return np.fromiter((len(out[i]) for i in range(len(windows))), np.int64, len(windows))

    def learn(self, unseen: set[bytes]) -> None:
        if len(self.memo) + len(unseen) > MEMO:
            self.memo.clear()
        new = list(unseen)
        for i in range(0, len(new), 8192):
            part = new[i : i + 8192]
            framed = [HEAD + b" " + w + b" " + TAIL for w in part]
            self.memo.update(zip(part, (self.lengths(self.plain, framed) - self.lengths(self.toxic, framed)).tolist()))

    def features(self, texts) -> np.ndarray:
        """One row a text: for each threshold how many windows pass it, and their share; the best window; the mean."""
        out = np.zeros((len(texts), 3 + 2 * len(STEPS)))
        for i, t in enumerate(texts):
            w = words(t)
            if unseen := {x for x in w if x not in self.memo}:
                self.learn(unseen)
                if any(x not in self.memo for x in w):  # the memo was cleared
                    self.learn(set(w))
            e = np.fromiter((self.memo[x] for x in w), np.int64, len(w))
            out[i, :3] = 1, min(8, e.max(initial=0)) / 4, e.sum() / (len(w) + 30)
            for k, step in enumerate(STEPS):
                n = (e >= step).sum()
                out[i, 3 + 2 * k : 5 + 2 * k] = np.log1p(n), 20 * n / (len(w) + 30)
        return out


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Logistic coefficients of weighted rows, by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _curve(x @ w)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.05 * w)
    return w


def _curve(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", doc_id: str = "doc_id", most=MAX_TRAIN):
    """(toxic dictionary, ordinary dictionary, calibration), or None without both classes.

    Rows without a label or an id are left out; of several texts of one id the smallest counts. Ids are chosen first, so
    that only chosen texts move: at most ``most[class]`` ids are broadcast.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).alias("_c")).distinct()
    known = known.join(docs.select(F.col(quoted(doc_id)).alias("_id")).distinct(), "_id")
    total = {r["_c"]: r["count"] for r in known.groupBy("_c").count().collect()}
    ids = known.where("false")
    for c in (1, 0):
        ids = ids.unionByName(known.where(F.col("_c") == c).orderBy(F.xxhash64("_id"), "_id").limit(most[c]))
    texts = docs.select(F.col(quoted(doc_id)).alias("_id"), F.col(quoted(text)).alias("_text")).join(F.broadcast(ids), "_id")
    chosen = texts.groupBy("_c", "_id").agg(F.min("_text").alias("_text")).orderBy("_c", F.xxhash64("_id"), "_id").collect()
    rows = [[r["_text"] or "" for r in chosen if r["_c"] == c] for c in (1, 0)]
    if not all(rows):
        return None
    # A dictionary knows its own texts too well: each half is measured with dictionaries of the other half.
    x, y = [], []
    for own in (0, 1):
        halves = [[r[own::2] or r, r[1 - own :: 2] or r] for r in rows]
        d = Distance(*train_dicts(halves[0][0], halves[1][0]))
        for c in (0, 1):
            x.append(d.features(halves[1 - c][1]))
            y.append(np.full(len(x[-1]), float(c)))
    y = np.concatenate(y)
    # The sample holds as many of both classes as it can; the curve is for the shares they have among all labelled rows.
    weight = np.where(y == 1, total[1] / len(rows[0]), total[0] / len(rows[1]))
    return *train_dicts(*rows), calibrate(np.concatenate(x), y, weight / weight.mean())


def score(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic likelier) of each whole text."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        d = Distance(*model[:2])
        for s in parts:
            yield pd.Series(_curve(d.features(s.tolist()) @ model[2]), dtype="float64")

    found = F.lit(0.0) if model is None else run(F.col(quoted(text)))
    return docs.select(boxed(docs), found.alias("_score")).select(*unboxed(docs.columns, ("score", F.col("_score"))))
