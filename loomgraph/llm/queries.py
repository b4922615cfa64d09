"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from pyspark.sql import functions as F

from . import ann, langid, licenses, line_dedup, mixing, packing, pii, quality, simhash, toxicity
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_rules(spark, d):
    out = licenses.scan(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", F.size("sentence_ids").cast("long").alias("n_known"), F.array_join("licenses", ",").alias("licenses"))


def op2_quality_rules(spark, d):
    out = quality.assess(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def op3_pii_surrogates(spark, d):
    out = pii.anonymize(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_entities"))


def op4_multi_index_hashing(spark, d):
    return ann.search(table(spark, d, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20)


def op5_best_fit_packing(spark, d):
    return packing.pack(table(spark, d, "documents").select("doc_id", "text"), tokenizer_path(), keep_ids=False)


def op6_mix_sources(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op7_toxicity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    labels = table(spark, d, "labels").select("doc_id", "toxic").where(_fold(3) != 1)
    model = toxicity.train(docs.where(_fold(3) != 1), labels)
    out = toxicity.score(docs, model)
    held = F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_language_id(spark, d):
    docs = table(spark, d, "documents")
    model = langid.train(docs.where(_fold(5) != 0).select("doc_id", "text", "lang"))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_simhash(spark, d):
    return simhash.classes(table(spark, d, "documents").select("doc_id", "text"), keep=["doc_id"])


def op10_line_spread(spark, d):
    out = line_dedup.dedup(table(spark, d, "documents").select("doc_id", "text", "source"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def pipeline(spark, d):
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES = {f.__name__: f for f in (
    op1_license_rules, op2_quality_rules, op3_pii_surrogates, op4_multi_index_hashing, op5_best_fit_packing, op6_mix_sources, op7_toxicity, op8_language_id,
    op9_simhash, op10_line_spread, pipeline,
)}

_W = r"[^\x20\x09-\x0D]"
SQL = {
    "op10_line_spread": rf"""
WITH lines AS (
  SELECT doc_id, source, pos, line, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS k
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), worded AS (SELECT * FROM lines WHERE regexp_matches(line, '{_W}')),
boiler AS (
  SELECT k, min((doc_id, pos)) AS first FROM worded GROUP BY k HAVING count(DISTINCT coalesce('=' || source, 'null')) >= 5
), marked AS (
  SELECT l.*, (regexp_matches(line, '{_W}') AND b.k IS NOT NULL AND (l.doc_id, l.pos) <> b.first) AS gone FROM lines l LEFT JOIN boiler b ON l.k = b.k
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN text IS NULL THEN NULL ELSE md5(coalesce(new_text, '')) END AS text_md5
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '{_W}')) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, false)) AS new_text
  FROM marked GROUP BY doc_id
) m ON d.doc_id = m.doc_id""",
}
