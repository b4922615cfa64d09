"""Resolution passes on one crowded file: work must not grow with the product of its rows."""

import random
import threading
from contextlib import contextmanager

from pyspark.sql import functions as F

from loomgraph.operators import resolve as r


@contextmanager
def within(spark, seconds):
    """Jobs still running after ``seconds`` are cancelled, which fails the test."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def test_enclosing_equals_brute_force(spark):
    rng = random.Random(3)
    funs = [(rng.choice("ab"), o, f"f{o}", rng.choice(["Function", "Method", "Class"]), (x := rng.randint(-9, 90)), x + rng.choice([-1, 0, 1, 7, 30, 64])) for o in range(120)]
    funs += [("a", 900, "whole", "Function", -(2**31), 2**31 - 1), ("b", 901, "none", "Function", None, 5), ("b", 902, "open", "Function", 5, None)]
    calls = [(rng.choice("abc"), o % 150, rng.choice([None, rng.randint(-20, 200)])) for o in range(300)]
    defs = r.symbols(spark.createDataFrame(funs, "path string, ordinal long, name string, kind string, start_line int, end_line int"), "p")
    got = r.enclosing(spark.createDataFrame(calls, "path string, ordinal long, line int"), defs).collect()
    want = []
    for path, o, line in calls:
        held = [f for f in funs if f[0] == path and f[3] != "Class" and None not in (line, f[4], f[5]) and f[4] <= line <= f[5]]
        if held:
            want.append((path, o, line, min(held, key=lambda f: f[1])[2]))
    assert sorted((x.path, x.ordinal, x.line, x.caller_name) for x in got) == sorted(want) and len(want) > 50


def test_enclosing_in_a_crowded_file(spark):
    n = 200_000
    funs = spark.range(n).select(F.lit("a.ts").alias("path"), F.col("id").alias("ordinal"), F.concat(F.lit("f"), "id").alias("name"), F.lit("Function").alias("kind"), F.col("id").cast("int").alias("start_line"), (F.col("id") + 50_000).cast("int").alias("end_line"))
    calls = spark.range(n).select(F.lit("a.ts").alias("path"), F.col("id").alias("ordinal"), F.col("id").cast("int").alias("line"))
    with within(spark, 60):
        got = r.enclosing(calls, r.symbols(funs, "p")).where(F.col("caller_name") == F.concat(F.lit("f"), F.greatest(F.lit(0), F.col("line") - 50_000))).count()
    assert got == n


def test_imports_of_one_name_in_many_modules(spark):
    """Equal symbols and imports stand many times; the first import with a fitting module counts."""
    n = 200_000
    defs = spark.range(n).select(F.concat(F.lit("m"), F.col("id") % 40, F.lit("/x.ts")).alias("path"), F.col("id").alias("ordinal"), F.lit("go").alias("name"), F.lit("Function").alias("kind"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"))
    uses = spark.range(n).select(F.concat(F.lit("u"), F.col("id") % 50, F.lit(".ts")).alias("path"), F.col("id").alias("ordinal"), F.lit("go").alias("name"), F.lit(None).cast("string").alias("original"), F.concat(F.lit("./m"), F.col("id") % 50, F.lit("/x")).alias("source"), F.lit(False).alias("is_type_only"))
    with within(spark, 60):
        got = {x.path: x.target for x in r.imported_symbols(uses, r.symbols(defs, "p")).collect()}
    assert got == {f"u{i}.ts": f"p.m{i}.x.go" for i in range(40)}


def test_words_in_texts_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda most: "".join(rng.choice("abé") for _ in range(rng.randint(0, most)))
    texts, words = [(rng.choice("kl"), word(9)) for _ in range(80)] + [("k", None)], [(rng.choice("kl"), word(4)) for _ in range(60)] + [("k", None), ("l", "")]
    want = sorted({(k, t, w) for k, t in texts for q, w in words if k == q and None not in (t, w) and w in t})
    a, b = spark.createDataFrame(texts, "_key string, _text string"), spark.createDataFrame(words, "_key string, _word string")
    for few in (0, 20, 1000):
        assert sorted(map(tuple, r.containing(a, b, few).collect())) == want


def test_tests_by_name_in_a_crowded_file(spark):
    """Every test names one of very many functions of its subject file, many of them twice."""
    n = 60_000
    own = lambda kind, path, name: spark.range(2 * n).select(F.lit(path).alias("path"), F.col("id").alias("ordinal"), F.concat(F.lit(name), F.lpad((F.col("id") % n).cast("string"), 6, "0")).alias("name"), F.lit(kind).alias("kind"))
    defs = own("Function", "a.ts", "f").unionByName(own("Test", "a.test.ts", "runs F"))
    none = spark.createDataFrame([], "path string, ordinal long, source string, name string, original string")
    with within(spark, 60):
        got = r.test_edges(r.symbols(defs, "p"), none)
        same = F.regexp_extract("source_id", "(.{6})$", 1) == F.regexp_extract("target_id", "(.{6})$", 1)
        assert got.agg(F.count(F.lit(1)), F.sum(same.cast("int"))).first() == (n, n)
