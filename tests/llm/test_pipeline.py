"""The pipeline's stages as a chain, each against brute force on its own input; queries without SQL against plain Python."""

import os
import random
import re
import zlib

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    body = lambda: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 14))) for _ in range(9))
    out = [body() for _ in range(40)]
    for i in range(8):  # boilerplate on many sources, near copies, exact copies
        out[i] += "\nread more of this  on our site"
    out += [out[10].replace(out[10].split()[3], "edited", 1), out[11] + " tail", out[12], out[12], "too short", "same same same " * 40, None, ""]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, f"s{i % 6}" if i % 9 else None) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{at}/documents.parquet")
    return at


def shingle_set(text):
    w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_chain(spark, folder, tmp_path):
    import corpus_pipeline as c
    from loomgraph.llm import quality

    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in c.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, folder)
        columns = docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert docs.columns == columns
        kept[name] = (before, docs.collect())
    before, after = kept["quality"]
    good = {r.doc_id for r in quality.assess(spark.createDataFrame(list(before.values()), "doc_id long, text string, source string")).where("kept").collect()}
    assert {r.doc_id for r in after} == good and set(range(44)) <= good and not good & {44, 45, 46, 47}
    before, after = kept["lines"]
    sites, first = {}, {}
    for i, r in sorted(before.items()):
        for k, line in enumerate(r.text.split("\n")):
            if WORD.search(line):
                key = " ".join(WORD.findall(line))
                sites.setdefault(key, set()).add(r.source)
                first.setdefault(key, (i, k))
    clean = lambda i, t: "\n".join(x for k, x in enumerate(t.split("\n")) if not WORD.search(x) or len(sites[" ".join(WORD.findall(x))]) < 5 or first[" ".join(WORD.findall(x))] == (i, k))
    assert {r.doc_id: r.text for r in after} == {i: clean(i, r.text) for i, r in before.items()}
    before, after = kept["near_copies"]
    sets, label = {i: shingle_set(r.text) for i, r in before.items()}, {i: i for i in before}
    for _ in range(5):
        for i in sets:
            for j in sets:
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    assert {r.doc_id for r in after} == set(label.values()) and len(after) < len(before)
    before, after = kept["mix"]
    from loomgraph.llm import mixing

    size = {i: len(WORD.findall(r.text)) for i, r in before.items()}
    names = sorted({r.source for r in before.values()}, key=lambda s: (s is None, s))
    sizes = [sum(size[i] for i, r in before.items() if r.source == s) for s in names]
    for s, goal in zip(names, mixing.targets(sizes)):
        taken = sum(size[r.doc_id] for r in after if r.source == s)
        assert abs(taken - goal) <= 2 * max(size.values())
    times = [r.doc_id for r in after]
    assert max(map(times.count, times)) <= 3
    pieces = kept["pack"][1]
    assert sum(r.piece == 0 for r in pieces) == len(after)
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_leaves_no_stage_folders(spark, folder):
    import corpus_pipeline as c
    from loomgraph.llm.common import shared_dir

    at = shared_dir(spark).removeprefix("file://")
    old = set(os.listdir(at))
    assert c.run(spark, folder).count() > 0
    made = [x for x in os.listdir(at) if x.startswith("cut-") and x not in old]
    assert len(made) <= 8  # those of the last stage and its input


def test_quality_measures(spark, folder):
    from loomgraph.llm.queries import op2_quality_rules

    for r in op2_quality_rules(spark, folder).collect():
        t = texts()[r.doc_id] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        at = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        repeated = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(repeated))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t)) and r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and not (r.kept and r.base_failed)


def test_packing_pieces(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    from loomgraph.llm.queries import op5_best_fit_packing

    slow, got = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for r in op5_best_fit_packing(spark, folder).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for i, t in enumerate(texts()):
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 1024 or 1024
        spans = [(0, head), *((s, 1024) for s in range(head, len(ids), 1024))]
        assert sorted(got[i]) == [(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(spans)]


def test_mixing_query(spark, folder):
    from loomgraph.llm import mixing
    from loomgraph.llm.queries import op6_mix_sources

    rows = op6_mix_sources(spark, folder).collect()
    assert rows == op6_mix_sources(spark, folder).collect() or sorted(map(tuple, rows)) == sorted(map(tuple, op6_mix_sources(spark, folder).collect()))
    source = {i: f"s{i % 6}" if i % 9 else None for i in range(len(texts()))}
    names = sorted(set(source.values()), key=lambda s: (s is None, s))
    sizes = [sum(len(WORD.findall(t or "")) for i, t in enumerate(texts()) if source[i] == s) for s in names]
    goals = dict(zip(names, mixing.targets(sizes)))
    for s, n in zip(names, sizes):
        own = [r for r in rows if source[r.doc_id] == s]
        assert {r.source_size for r in own} == {n} and {r.target for r in own} == {goals[s]}
        assert abs(sum(r.taken for r in own) - goals[s]) <= 64 and all(0 <= r.taken <= 3 * r.size for r in own)


def test_language_model_on_held_out_rows(spark):
    from loomgraph.llm import langid

    rng = random.Random(2)
    sounds = {"en": ["the", "ing", "th", "er"], "de": ["sch", "ung", "ei", "ß"], "fr": ["eau", "eux", "é", "qu"], "es": ["ción", "ñ", "os", "ll"]}
    made = lambda c: " ".join("".join(rng.choice(sounds[c]) for _ in range(3)) for _ in range(30))
    rows = [(i, made(c), c) for i, c in enumerate(c for _ in range(20) for c in sounds)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id < 60"))
    got = langid.identify(df.where("doc_id >= 60"), model).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got) and len(got) == 20
