"""Operators against brute force, round trips and edge cases on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import ann, langid, licenses, line_dedup, mixing, near, packing, pii, quality, simhash, toxicity

ROWS = [(1, "a b c\na b c\n", "s1"), (1, "a b c\na b c\n", "s1"), (2, None, None), (3, "", "s2"), (None, "mail x@y.example.com now", "s2"), (4, "w " * 30_000, "s1")]
#: Names that operators use for themselves or return; a caller's columns of these names must do no harm.
OWN = ["_row", "_rid", "_fp", "_key", "_label", "_id", "_text", "_size", "_src", "_shard", "_p", "_s", "_n", "_gone", "_parts", "_chain", "_times"]
RETURNED = {
    "quality": ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", "kept"],
    "licenses": ["n_sentences", "sentence_ids", "licenses"], "pii": ["pii"], "mixing": ["size", "source_size", "target", "taken"],
    "toxicity": ["score"], "langid": ["lang_pred", "score"], "simhash": ["fingerprint", "component_id"], "line_dedup": ["n_lines", "n_removed"], "near": [],
}
APPLY = {
    "quality": quality.assess, "licenses": licenses.scan, "pii": lambda d: pii.anonymize(d, b"k"), "mixing": mixing.mix, "toxicity": lambda d: toxicity.score(d, MODEL),
    "langid": lambda d: langid.identify(d, None), "simhash": simhash.classes, "line_dedup": lambda d: line_dedup.dedup(d, counts=True), "near": lambda d: d if near.dedup(d).count() in (0, 4) else None,
}
MODEL = (*toxicity.train_dicts(["you idiot", "idiot you"] * 9, ["good day to all", "a fine day"] * 9), np.array([-1.0] + [0.1] * 10))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, s, 0) for i, t, s in ROWS], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("name", APPLY)
def test_edge_rows(docs, name):
    """Nulls, empty and long texts, repeated rows, empty tables and clashing names: rows stay, clashes resolve as documented."""
    returned = RETURNED[name]
    plain = APPLY[name](docs)
    assert plain.count() == len(ROWS) and [c for c in plain.columns if c in docs.columns] == [c for c in docs.columns if c in plain.columns]
    assert APPLY[name](docs.limit(0)).count() == 0
    clashing = docs.select("*", *[F.lit("mine").alias(c) for c in [*OWN, *returned]])
    got = APPLY[name](clashing)
    assert len(set(got.columns)) == len(got.columns) and set(OWN + returned) <= set(got.columns)
    assert got.select(OWN).distinct().collect() == [tuple(["mine"] * len(OWN))]
    assert {str(r) for r in got.select(plain.columns).collect()} == {str(r) for r in plain.collect()}


def test_rows_that_go(docs):
    """Filtering forms keep the columns as given and one row of each group."""
    clashing = docs.select("*", F.lit("mine").alias("_key"), F.lit(7).alias("taken"))
    for out, n in ((simhash.dedup(clashing), 4), (near.dedup(clashing), 4), (mixing.resample(clashing), None)):
        assert out.columns == clashing.columns and (n is None or out.count() == n)
        assert {r[0] for r in out.select("_key").collect()} <= {"mine"}


def test_packing_edge_rows(docs):
    from loomgraph.llm.queries import tokenizer_path

    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0
    pieces = packing.pack(docs.withColumn("length", F.lit("mine")), tokenizer_path()).toPandas()
    assert pieces.groupby("piece").size()[0] == len(ROWS)
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 1024


def test_license_rules(spark):
    d = spark.createDataFrame([(1, "Code.\nLicensed under the Apache License, Version 2.0. Yes"), (2, "MIT License\nnone")], "doc_id long, text string")
    assert [r[0] for r in licenses.scan(d).orderBy("doc_id").select("licenses").collect()] == [["Apache-2.0"], ["MIT"]]


def test_repeat_words(spark):
    d = spark.createDataFrame([(1, "a b c x a b c d"), (2, "a a a a"), (3, "a b")], "doc_id long, text string")
    assert [r[0] for r in quality.measures(d).orderBy("doc_id").select("n_repeat_words").collect()] == [6, 4, 0]


def test_pii_is_one_to_one():
    key = b"k"
    ips = [f"10.0.{i}.{j}" for i in range(8) for j in range(8)]
    assert len({pii.surrogate(x, "ip", key) for x in ips}) == len(ips)
    assert len({pii.permute(i, 1000, key, "t") for i in range(1000)}) == 1000
    assert pii.replace("Mr. John Smith", key)[1][0][3].split()[0] in pii.NAMES["m"]
    card = pii.surrogate("4111 1111 1111 1111", "card", key).replace(" ", "")
    assert pii._luhn(card[:-1]) == card[-1]


def test_trie_equals_brute_force():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    codes = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(6))]))
    got = {int(c): int(c) for c in codes} | dict(simhash.trie_forest(codes, 3, chunk=64))
    near, label = np.bitwise_count(codes[:, None] ^ codes[None]) <= 3, np.arange(len(codes))
    for _ in range(60):
        label = np.where(near, label[None], len(codes)).min(1)
    assert [got[int(c)] for c in codes] == codes[label].tolist()


def test_dealt_cells_lose_no_link(spark):
    rng = np.random.default_rng(1)
    codes = np.unique(np.concatenate([np.arange(1, 400, dtype=np.uint64) << np.uint64(9), rng.integers(0, 1 << 63, 50, dtype=np.uint64)])).view("int64")
    fps = spark.createDataFrame([(int(c),) for c in codes], "_fp long")
    edges = [tuple(r) for r in simhash.links(fps, cell=40).collect()]
    root = {int(c): int(c) for c in codes}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in edges:
        root[find(a)] = find(b)
    u = codes.view("uint64")
    near, label = np.bitwise_count(u[:, None] ^ u[None]) <= 3, np.arange(len(u))
    for _ in range(60):
        label = np.where(near, label[None], len(u)).min(1)
    assert len({find(int(c)) for c in codes}) == len(set(label.tolist()))


def test_sainte_lague_equals_highest_quotients():
    for seed in range(20):
        shares = np.random.default_rng(seed).random(7).tolist()
        got = [0] * 7
        for _ in range(23):
            got[max(range(7), key=lambda i: (shares[i] / (2 * got[i] + 1), -i))] += 1
        assert mixing.sainte_lague(shares, 23) == got


def test_packing_near_the_bound():
    rng = np.random.default_rng(2)
    counts = {int(n): int(k) for n, k in zip(*np.unique(rng.integers(1, 1025, 3000), return_counts=True))}
    plan = packing.configure(counts)
    placed = {}
    for pattern, times in plan:
        assert sum(n * k for n, k in pattern.items()) <= 1024
        for n, k in pattern.items():
            placed[n] = placed.get(n, 0) + k * times
    assert placed == counts
    assert sum(t for _, t in plan) <= 1.03 * sum(n * k for n, k in counts.items()) / 1024


def _exact(x, ids, q, k):
    """Brute force: ids of the k largest inner products with row q, the row itself left out."""
    s = x @ x[q]
    order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], ids[i]))[:k]
    return [(ids[i], s[i]) for i in order]


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_ann_recall(spark, spread):
    """Vectors of one length and of log-normal lengths."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 16)) * np.exp(spread * rng.standard_normal((600, 1)))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)] + [(700, None, 1), (701, [0.0] * 16, 1), (702, [float("nan")] * 16, 1), (740, [1.0, 2.0], 1)], "vec_id long, embedding array<double>, score int")
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=10).toPandas()
    hits = sum(len({i for i, _ in _exact(x, list(range(600)), q, 10)} & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hits / len(got) >= 0.9 and got["query_id"].nunique() == 30
    assert all(abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-9 for r in got.itertuples())


def test_ann_repeated_ids_and_outliers(spark):
    """Fewer rows than a block's share: the result is exact, row by row, also for repeated and null ids."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 8))
    x[7] = 100 * x[20]
    ids = [*range(58), 20, 33]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)] + [(None, x[0].tolist())], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=5, share=1.0).toPandas()
    y, all_ids = np.vstack([x, x[:1]]), [*ids, 1 << 62]
    want = sorted((ids[q], r, None if i == 1 << 62 else i) for q in range(60) if ids[q] % 20 == 0 for r, (i, _) in enumerate(_exact(y, all_ids, q, 5), 1))
    clean = sorted((int(r.query_id), int(r.rank), None if r.vec_id != r.vec_id else int(r.vec_id)) for r in got.itertuples())
    assert sorted(clean, key=str) == sorted(want, key=str)
    assert got[(got.query_id == 20) & (got["rank"] == 1)].vec_id.tolist()[0] == 7
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_components_of_long_chains(spark):
    """A path of 300 nodes in random order is one component; another stays alone."""
    ids = np.random.default_rng(5).permutation(300).tolist()
    nodes = spark.createDataFrame([(i, i) for i in [*ids, 900]], "_fp long, _key long")
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "_fp long, _root long")
    got = {r[0]: r[1] for r in simhash.components(nodes, edges).collect()}
    assert got == {**dict.fromkeys(ids, 0), 900: 900}


def test_languages_need_letters():
    assert langid.features("½ ² ③ ① 12 _") is None and langid.features("x") is not None


def test_toxicity_finds_the_word():
    d = toxicity.Distance(*MODEL[:2])
    d.learn({b"idiot", b"day"})
    assert d.memo[b"idiot"] > 0 >= d.memo[b"day"]
