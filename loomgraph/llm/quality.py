"""Quality rules by weak supervision.

Each rule votes good (1), bad (0) or abstains (-1) on a document. Documents are counted by vote pattern (at most 3 to the
power of the number of rules, whatever the input), expectation-maximisation over the patterns estimates each rule's
accuracies, and the posterior probability of quality decides. Everything runs in DataFrame expressions; only the bounded
pattern counts reach the driver.

Null or empty texts have no words, fail the base rules and are not kept; very long texts are read whole; equal texts get
equal verdicts, however often a row repeats. An empty table gives an empty result.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, boxed, cut, let, quoted, unboxed, words

#: rule -> (signal, good at or below (None: never votes good), bad above); between the two the rule abstains.
RULES = {
    "symbols": ("s_symbols", None, 0.2),
    "shouting": ("s_upper", None, 0.5),
    "exclaims": ("s_exclaim", None, 0.3),
    "repeats": ("s_repeat", None, 0.3),
    "dup_lines": ("s_dup", None, 0.3),
    "letters": ("s_other", 0.06, 0.1),
    "word_length": ("s_length", 12.0, 20.0),
}


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, over whole texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda s: F.regexp_like(s, F.lit(WORD)))
    windows = lambda w: F.transform(
        F.when(F.size(w) >= 3, F.sequence(F.lit(1), F.size(w) - 2)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("w"), i.alias("i")),
    )
    same = lambda a, i, j: F.coalesce(F.get(a, i)["w"] == F.get(a, j)["w"], F.lit(False))
    # Equal windows stand side by side once sorted; starts of repeated ones mark three words each.
    starts = lambda s: F.filter(F.transform(s, lambda x, i: F.when(same(s, i, i - 1) | same(s, i, i + 1), x["i"])), lambda x: x.isNotNull())
    covered = let(F.array_sort(let(words(F.col(text)), windows)), lambda s: F.size(F.array_distinct(F.flatten(F.transform(starts(s), lambda p: F.sequence(p, p + 2))))))
    n = F.length(F.regexp_replace(F.regexp_replace(t, WORD, "x"), r"[\x20\x09-\x0D]+", ""))
    out = docs.select(
        "*",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).alias("_upper"),
        F.length(F.regexp_replace(t, r"[^!]+", "")).alias("_exclaim"),
        F.size(lines).alias("_lines"),
        F.length(F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}]+", "")).alias("_plain"),
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return out.select(
        *[c for c in out.columns if c not in ("_upper", "_exclaim", "_lines", "_plain")],
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        per("n_symbols", "n_words").alias("s_symbols"), per("_upper", "word_chars").alias("s_upper"), per("_exclaim", "n_words").alias("s_exclaim"),
        per("n_repeat_words", "n_words").alias("s_repeat"), per("n_dup_lines", "_lines").alias("s_dup"), per("word_chars", "n_words").alias("s_length"),
        (1 - per("_plain", "word_chars")).alias("s_other"),
    )


def vote(df: DataFrame) -> DataFrame:
    """Add one column ``v_<rule>`` per rule: 1 good, 0 bad, -1 abstains (no word: every rule abstains)."""
    return df.select("*", *[
        F.when(F.col("n_words") == 0, -1).when(F.lit(good is not None) & (F.col(s) <= F.lit(good)), 1).when(F.col(s) > bad, 0).otherwise(-1).alias(f"v_{r}") for r, (s, good, bad) in RULES.items()
    ])


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[dict[int, float]]]:
    """EM over (votes, count): the prior log-odds of quality and, per rule, the log-odds that each vote adds.

    A rule's chance of a right vote starts at 0.9 and stays between 0.6 and 0.995 (rules are better than chance).
    """
    k = len(RULES)
    prior, acc = 0.8, [[0.9, 0.9] for _ in range(k)]  # acc[r][c]: chance that rule r, when it votes, is right on class c
    for _ in range(rounds):
        seen, right, good, total = [[0.0, 0.0] for _ in range(k)], [[0.0, 0.0] for _ in range(k)], 0.0, 0.0
        for votes, count in patterns:
            odds = math.log(prior / (1 - prior))
            for r, v in enumerate(votes):
                if v >= 0:
                    odds += math.log(acc[r][1] / (1 - acc[r][0])) if v else math.log((1 - acc[r][1]) / acc[r][0])
            p = 1 / (1 + math.exp(-odds))
            good, total = good + p * count, total + count
            for r, v in enumerate(votes):
                if v >= 0:
                    for c, share in ((1, p), (0, 1 - p)):
                        seen[r][c] += share * count
                        right[r][c] += share * count * (v == c)
        if not total:
            break
        prior = min(0.98, max(0.02, good / total))
        acc = [[min(0.995, max(0.6, (right[r][c] + 9) / (seen[r][c] + 10))) for c in (0, 1)] for r in range(k)]
    return math.log(prior / (1 - prior)), [{1: math.log(a[1] / (1 - a[0])), 0: math.log((1 - a[1]) / a[0])} for a in acc]


def judge(voted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``posterior`` (double) and ``kept`` (boolean). ``voted`` is counted once, so give it a written table."""
    names = [f"v_{r}" for r in RULES]
    counts = voted.groupBy(*names).count().collect()  # at most 3 ** len(RULES) rows
    base, gains = fit([(tuple(r[n] for n in names), r["count"]) for r in sorted(counts)])
    odds = F.lit(base)
    for n, g in zip(names, gains):
        odds = odds + F.when(F.col(n) == 1, g[1]).when(F.col(n) == 0, g[0]).otherwise(0.0)
    p = 1 / (1 + F.exp(-odds))
    return voted.withColumn("posterior", p).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def assess(docs: DataFrame, text: str = "text", keep=None) -> DataFrame:
    """Measures, votes, posterior and verdict of every row; own columns of their names are replaced.

    ``keep``: columns carried along (default: all but the text).
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    slim = vote(measures(docs.select(boxed(docs, keep), F.col(quoted(text)).alias("_text")), "_text"))
    new = [c for c in slim.columns if c not in ("_row", "_text")]
    judged = judge(cut(slim.drop("_text")))
    return judged.select(*unboxed(keep, *[(c, F.col(c)) for c in (*new, "posterior", "kept")]))
