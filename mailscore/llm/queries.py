"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from mailscore.llm import (
    decontaminate, embeddings, filter_audit, language_id, lexical_search, licenses, minhash, packing, scoring_lm, substring_dedup, surrogates,
    token_counts, toxicity,
)
from mailscore.llm.blocks import crc_mod, documents, importable

KEY = "surrogates of the test tables"  # a real run takes its key from a secret store


def op1_token_counts(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_lm_scoring(spark, sf_dir):
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0
    return scoring_lm.score(documents(spark, sf_dir), crc_mod("doc_id", 7) != 2, fold)


def op3_license_scan(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


def op4_pii_surrogates(spark, sf_dir):
    return surrogates.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), KEY)


def op5_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = language_id.fit(language_id.training_rows(docs))
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return language_id.predict(docs.select("doc_id", held_out, "text"), model).drop("text")


def op6_best_fit_packing(spark, sf_dir):
    return packing.pack(packing.pieces(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))


def op7_embedding_near_dedup(spark, sf_dir):
    importable(spark)
    return embeddings.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op9_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(documents(spark, sf_dir))


def op11_toxicity(spark, sf_dir):
    """doc_id, held_out, score, predicted of every document, and the labelled examples that speak for it."""
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_lexical_search(spark, sf_dir):
    """item_id, rank, doc_id, score of the ten best documents for every benchmark item."""
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_filter_audit(spark, sf_dir):
    """Counts for every part, order of the five filters, and step."""
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {f.__name__: f for name, f in list(globals().items()) if name.startswith("op")}

ORACLES = {
    "op12_lexical_search": r"""
WITH q AS (SELECT DISTINCT item_id, text FROM benchmark),
  terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
  sizes AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM terms GROUP BY doc_id),
  whole AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sizes),
  item_terms AS (SELECT item_id, text, term, CAST(count(*) AS BIGINT) AS q FROM (SELECT item_id, text,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM q) GROUP BY item_id, text, term),
  tf AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM terms WHERE term IN (SELECT term FROM item_terms) GROUP BY doc_id, term),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, whole),
  impact AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length)) AS x
    FROM tf JOIN sizes USING (doc_id), whole),
  scores AS (SELECT item_id, text, doc_id, CAST(sum(q * w * x) AS BIGINT) AS score
    FROM item_terms JOIN weights USING (term) JOIN impact USING (term) GROUP BY item_id, text, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *,
  row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
""",
    "op13_filter_audit": r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
  words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
  judged AS (SELECT doc_id, part,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS failed FROM words),
  marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
  counts AS (SELECT part, failed, count(*) AS n, count(*) FILTER (coalesce(good, false)) AS good, count(*) FILTER (coalesce(bad, false)) AS bad
    FROM judged LEFT JOIN marks USING (doc_id) GROUP BY part, failed),
  letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
  orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
  steps AS (SELECT filter_order, s.step, substr(filter_order, s.step, 1) AS f FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s),
  met AS (SELECT part, n, good, bad, failed, filter_order, step, f, contains(failed, f) AS fails,
    len(translate(substr(filter_order, 1, step - 1), failed, '')) < step - 1 AS before FROM counts, steps),
  summed AS (SELECT part, filter_order, step, f,
    sum(n) FILTER (NOT fails AND NOT before) AS kept, sum(n) FILTER (fails AND NOT before) AS removed, sum(n) FILTER (fails AND before) AS redundant,
    sum(n) FILTER (failed = f) AS unique_fails, sum(good) FILTER (fails AND NOT before) AS good_lost,
    sum(bad) FILTER (fails AND NOT before) AS toxic_lost FROM met GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM summed
""",
}
