"""The pipeline's near-copy stage against brute force."""

import numpy as np

import corpus_pipeline
from loomgraph.llm import near


def test_edited_copies_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(40):
        base = [f"w{i}" for i in rng.integers(0, 5000, int(rng.integers(30, 400)))]
        for edits in (0, 0, 1, 2, 4, 8, 16):
            w = list(base)
            for at in rng.integers(0, len(w), edits if len(texts) % 7 else 0):
                w[at] = f"e{rng.integers(0, 10**9)}"
            texts.append(" ".join(w))
    texts += ["", None, "one two", "One  two", "one three"]
    ids = rng.permutation(len(texts)).tolist()
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for t in texts for w in [(t or "").lower().split()]]
    label = list(ids)
    links = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(len(texts)):
        old = list(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if old == label:
            break
    docs = spark.createDataFrame([(i, t) for i, t in zip(ids, texts)], "doc_id long, text string").repartition(4)
    got = {r[0] for r in corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id").collect()}
    assert got == set(label) and 45 < len(got) < len(texts) - 60
    parted = {r[0] for r in near.dedup(docs, part=2).select("doc_id").collect()}
    assert parted == got


def test_lookalikes_in_parts(spark):
    """Texts that share most of their words lie in the same buckets without being near copies; in parts they give the same rows."""
    rng = np.random.default_rng(6)
    frame = [f"f{i}" for i in range(400)]
    texts = [" ".join(frame + [f"u{i}x{k}" for k in range(60)]) for i in range(30)]
    texts += [t + f" more{i}" for i, t in enumerate(texts[:10])] + [" ".join(f"w{x}" for x in rng.integers(0, 9999, 50))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole, parts = ([r[0] for r in near.dedup(docs, part=p).orderBy("doc_id").select("doc_id").collect()] for p in (1000, 4))
    assert whole == parts == [*range(30), 40]
