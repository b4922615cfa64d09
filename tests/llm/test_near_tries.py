"""The near-copy stage gets its candidates from SimHash tries."""

import numpy as np
import pytest

import corpus_pipeline
from loomgraph.llm import near


def test_trie_groups_equal_brute_force():
    rng = np.random.default_rng(1)
    codes = np.repeat(rng.integers(0, 1 << 28, 150), 4)
    for _ in range(2):
        codes ^= (rng.random(len(codes)) < 0.7) * (1 << rng.integers(0, 28, len(codes)))
    tails = rng.integers(0, 1 << 64, (len(codes), 2), dtype=np.uint64)
    tails[rng.random(len(codes)) < 0.8] = 1 << 63
    label, old = np.arange(len(codes)), None
    while (label != old).any() if old is not None else True:
        old = label.copy()
        for i in range(len(codes)):
            near_ = (np.bitwise_count(codes[i] ^ codes) <= near.RADIUS) & (np.bitwise_count(tails[i] ^ tails).sum(1) <= near.FAR)
            label[near_] = label[near_].min()
    for leaf, chunk in ((4, 1 << 18), (1, 3)):
        groups = near.trie_groups(codes, tails, leaf, chunk)
        assert ((groups[:, None] == groups) == (label[:, None] == label)).all()
    assert len(set(label)) < len(codes) - 50


def test_similar_sets_share_a_code():
    rng, least = np.random.default_rng(2), 96
    for n in (9, 18, 90, 900):
        for _ in range(30):
            x = rng.integers(0, 1 << 63, n * 10 // 9, dtype=np.uint64)
            (a, p), (b, q) = near.simhash(x[: n * 8 // 9 + n // 9]), near.simhash(x[n // 9 :])
            least = min(least, int((np.bitwise_count(p ^ q) <= near.RADIUS).sum()))
            assert np.bitwise_count(a ^ b).sum() <= near.FAR
    assert least > 0


@pytest.mark.parametrize("cell", [near.CELL, 10])
def test_stage_works_by_tries(spark, monkeypatch, cell):
    """Without the tries' buckets nothing links but sets of 4 and 5; dealt into cells they give the same rows."""
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.integers(0, 9999, 100)] for _ in range(12)]
    texts = [" ".join(w) for w in base] + [" ".join([*w[:60], "new", *w[61:]]) for w in base] + ["a b c d e f g h", "a b c d e f g h i"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r[0] for r in near.dedup(docs, cell=cell).select("doc_id").collect()) == [*range(12), 24]
    monkeypatch.setattr(near, "trie_groups", lambda codes, *_: np.arange(len(codes)))
    monkeypatch.setattr(near, "buckets", lambda nodes, cell, found=near.buckets: found(nodes, cell).where("false"))
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == len(texts)
