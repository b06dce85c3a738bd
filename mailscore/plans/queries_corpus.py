"""Registered queries: labels, cleaning, length and label reports, dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscore import constants as c
from mailscore.functions import labels, risk
from mailscore.operators import analytics, quality, schema, store
from mailscore.plans import oracle as o
from mailscore.plans.queries_features import TEXTS  # noqa: F401  (registers the feature queries first)
from mailscore.plans.queries_store import history
from mailscore.plans.registry import R
from mailscore.sources import fixtures as fx

NUMBER = r"CASE WHEN NOT regexp_matches(raw_label, '[0-9.][dDfF]\s*$') THEN try_cast(raw_label AS DOUBLE) END"
LABELLED = "emails WHERE label IS NOT NULL"


def labelled(spark, sf) -> DataFrame:
    return fx.emails(spark, sf).where(F.col("label").isNotNull())


# ------------------------------------------------------------- labels, cleaning
@R.query(
    "flt1_valid_labels",
    "SELECT email_id, label FROM emails WHERE label IN (0, 1)",
)
def valid_labels(spark, sf):
    return fx.emails(spark, sf).where(quality.valid_label(F.col("label"))).select("email_id", "label")


@R.query("flt2_numeric_labels", f"SELECT email_id, num FROM (SELECT email_id, {NUMBER} AS num FROM raw_labels) WHERE num IN (0, 1)")
def numeric_labels(spark, sf):
    df = fx.raw_labels(spark, sf).select("email_id", labels.numeric_label(F.col("raw_label")).alias("num"))
    return df.where(F.col("num").isin(0.0, 1.0))


@R.query("flt3_complete_rows", "SELECT email_id, raw_label FROM raw_labels WHERE body IS NOT NULL AND raw_label IS NOT NULL")
def complete_rows(spark, sf):
    return fx.raw_labels(spark, sf).dropna(subset=["body", "raw_label"]).select("email_id", "raw_label")


@R.query(
    "flt4_prepared_rows",
    f"SELECT email_id, label FROM (SELECT *, {NUMBER} AS label FROM raw_labels) WHERE label IN (0, 1) AND length(body) > 10",
)
def prepared_rows(spark, sf):
    return quality.prepare_rows(fx.raw_labels(spark, sf)).select("email_id", "label")


@R.query("flt5_extreme_lengths", "SELECT doc_id, n_chars FROM documents WHERE length(text) > 100000")
def extreme_rows(spark, sf):
    return fx.table(spark, sf, "documents").where(F.length("text") > c.EXTREME_LENGTH).select("doc_id", "n_chars")


@R.query(
    "sc12_strict_label",
    f"""SELECT email_id, CASE WHEN v IN {o.in_list(c.PHISHING_LABELS)} THEN 1 WHEN v IN {o.in_list(c.LEGITIMATE_LABELS)} THEN 0
      ELSE -1 END AS label FROM (SELECT *, lower({o.trim_ws('raw_label')}) AS v FROM raw_labels)""",
)
def strict_label(spark, sf):
    """Known labels; unknown ones, which would stop a strict job, as -1."""
    known = labels.known_label(F.col("raw_label"))
    return fx.raw_labels(spark, sf).select("email_id", F.coalesce(known, F.lit(-1)).alias("label"))


@R.query(
    "sc12_quarantine",
    f"""SELECT coalesce(raw_label, '(missing)') AS raw_label, count(*) AS n FROM (SELECT *, lower({o.trim_ws('raw_label')}) AS v FROM raw_labels)
      WHERE v IS NULL OR v NOT IN {o.in_list(c.PHISHING_LABELS + c.LEGITIMATE_LABELS)} GROUP BY 1""",
)
def quarantine(spark, sf):
    rejected = quality.quarantine_labels(fx.raw_labels(spark, sf), "raw_label")[1]
    return rejected.groupBy(F.coalesce("raw_label", F.lit("(missing)")).alias("raw_label")).agg(F.count("*").alias("n"))


@R.query(
    "sc13_lenient_label",
    f"""SELECT email_id, CASE WHEN v IN {o.in_list(c.LENIENT_PHISHING_LABELS)} THEN 1 WHEN v IN {o.in_list(c.LENIENT_LEGITIMATE_LABELS)} THEN 0
      ELSE (abs(coalesce({NUMBER.replace('raw_label', 'v')}, 0)) >= 1)::INT END AS label
    FROM (SELECT *, lower({o.trim_ws('raw_label')}) AS v FROM raw_labels)""",
)
def lenient_label(spark, sf):
    return fx.raw_labels(spark, sf).select("email_id", labels.lenient_label(F.col("raw_label")).alias("label"))


@R.query(
    "ag10_label_check",
    f"""SELECT count(*) AS total, count_if(coalesce(num IN (0, 1), false))::BIGINT AS valid,
      count_if(NOT coalesce(num IN (0, 1), false))::BIGINT AS invalid, count_if(num IS NULL)::BIGINT AS not_a_number
    FROM (SELECT {NUMBER} AS num FROM raw_labels)""",
)
def label_check(spark, sf):
    return quality.label_check(fx.raw_labels(spark, sf), "raw_label")


@R.query(
    "tk3_invalid_sample",
    f"""SELECT email_id, coalesce(raw_label, '(missing)') AS raw_label FROM (SELECT *, {NUMBER} AS num FROM raw_labels)
    WHERE NOT coalesce(num IN (0, 1), false) ORDER BY email_id LIMIT 10""",
)
def invalid_sample(spark, sf):
    df = fx.raw_labels(spark, sf).where(~quality.valid_label(labels.numeric_label(F.col("raw_label"))))
    return df.orderBy("email_id").limit(10).select("email_id", F.coalesce("raw_label", F.lit("(missing)")).alias("raw_label"))


@R.query(
    "ag21_top_labels",
    "SELECT raw_label, count(*) AS n FROM raw_labels WHERE raw_label IS NOT NULL GROUP BY 1 ORDER BY n DESC, raw_label LIMIT 20",
)
def top_labels(spark, sf):
    return analytics.top_labels(fx.raw_labels(spark, sf), "raw_label")


# ------------------------------------------------------------------ distributions
@R.query("ag1_label_counts", f"SELECT label, count(*) AS n FROM {LABELLED} GROUP BY label")
def label_counts(spark, sf):
    return analytics.label_counts(labelled(spark, sf))


@R.query(
    "ag2_label_percentages",
    f"""SELECT label, CASE WHEN label = 0 THEN 'Legitimate (0)' ELSE 'Phishing (1)' END AS label_name, count(*) AS n,
      {o.r6('count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()')} AS percentage FROM {LABELLED} GROUP BY label""",
)
def label_percentages(spark, sf):
    df = analytics.label_percentages(fx.emails(spark, sf))
    return df.withColumn("percentage", risk.round6(F.col("percentage")))


@R.query(
    "ag3_length_description",
    f"""SELECT count(n) AS count, {o.r6('avg(n)')} AS mean, {o.r6('stddev_samp(n)')} AS std, min(n)::INT AS min,
      quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q75, max(n)::INT AS max FROM lens""",
)
def length_description(spark, sf):
    df = analytics.length_description(analytics.length_counts(fx.emails(spark, sf)))
    return df.withColumns({n: risk.round6(F.col(n)) for n in ("mean", "std")})


@R.query(
    "ag4_length_by_label",
    f"""SELECT label, count(*) AS count, {o.r6('avg(n)')} AS mean, quantile_cont(n, 0.5) AS median, min(n)::INT AS min, max(n)::INT AS max
    FROM lens WHERE label IS NOT NULL GROUP BY label""",
)
def length_by_label(spark, sf):
    df = analytics.length_by_label(analytics.length_counts(fx.emails(spark, sf), by=("label",)))
    return df.withColumn("mean", risk.round6(F.col("mean")))


@R.query("ag5_length_histogram", "SELECT bucket, count(*) AS n FROM buckets WHERE bucket IS NOT NULL GROUP BY bucket")
def length_histogram(spark, sf):
    return analytics.length_histogram(analytics.length_counts(fx.emails(spark, sf)))


@R.query(
    "ag6_length_crosstab",
    """SELECT coalesce(bucket, 'All') AS bucket, coalesce(label::VARCHAR, 'All') AS label, count(*) AS n FROM buckets
    WHERE bucket IS NOT NULL AND label IS NOT NULL GROUP BY CUBE (bucket, label)""",
)
def length_crosstab(spark, sf):
    return analytics.length_crosstab(analytics.length_counts(fx.emails(spark, sf), by=("label",)))


@R.query(
    "ag7_phishing_rate_by_length",
    f"""SELECT bucket, count(*) AS n, {o.r6('avg(coalesce((label = 1)::INT, 0)) * 100')} AS phishing_rate FROM buckets
    WHERE bucket IS NOT NULL GROUP BY bucket""",
)
def phishing_rate_by_length(spark, sf):
    df = analytics.phishing_rate_by_length(analytics.length_counts(fx.emails(spark, sf), by=("label",)))
    return df.withColumn("phishing_rate", risk.round6(F.col("phishing_rate")))


@R.query(
    "ag8_extreme_lengths",
    f"""SELECT count(*) AS total, count_if(label = 1)::BIGINT AS phishing, count_if(label = 0)::BIGINT AS legitimate,
      coalesce({o.r6('avg(coalesce((label = 1)::INT, 0)) * 100')}, -1) AS phishing_rate FROM lens WHERE n > 5000""",
)
def extreme_lengths(spark, sf):
    """The test texts are short, so the long ones begin at 5,000 characters here."""
    df = analytics.extreme_lengths(fx.emails(spark, sf), above=5000)
    return df.withColumn("phishing_rate", F.coalesce(risk.round6(F.col("phishing_rate")), F.lit(-1.0)))


@R.query("ag9_length_median", "SELECT quantile_cont(n, 0.5) AS median FROM lens")
def length_median(spark, sf):
    return analytics.length_median(analytics.length_counts(fx.emails(spark, sf)))


@R.query(
    "ag12_dashboard",
    f"""SELECT total, analyzed, phishing, benign, total - analyzed AS not_analyzed,
      coalesce({o.r6('avg_c')}, 0) AS avg_confidence, coalesce({o.r6('min_c')}, 0) AS min_confidence, coalesce({o.r6('max_c')}, 0) AS max_confidence,
      {o.r6('coalesce(phishing * 100.0::DOUBLE / nullif(analyzed, 0), 0)')} AS phishing_percentage,
      {o.r6('coalesce(benign * 100.0::DOUBLE / nullif(analyzed, 0), 0)')} AS benign_percentage
    FROM (SELECT count(*) AS total, count(prediction) AS analyzed, count_if(prediction = 1)::BIGINT AS phishing,
      count_if(prediction = 0)::BIGINT AS benign, avg(probability) AS avg_c, min(probability) AS min_c, max(probability) AS max_c
      FROM emails LEFT JOIN latest USING (email_id))""",
)
def dashboard(spark, sf):
    df = analytics.dashboard(store.with_latest_prediction(fx.emails(spark, sf), fx.predictions(spark, sf)))
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: risk.round6(F.col(n)) for n in doubles})


@R.query(
    "ag15_run_summary",
    f"""SELECT count(DISTINCT source) AS num_datasets, count(*) AS num_samples, count_if(label = 0)::BIGINT AS legitimate,
      count_if(label = 1)::BIGINT AS phishing FROM {LABELLED}""",
)
def run_summary(spark, sf):
    df = analytics.run_summary(labelled(spark, sf), "source", "label")
    by = F.col("label_distribution")
    return df.select(
        "num_datasets",
        "num_samples",
        F.coalesce(F.try_element_at(by, F.lit("0")), F.lit(0)).alias("legitimate"),
        F.coalesce(F.try_element_at(by, F.lit("1")), F.lit(0)).alias("phishing"),
    )


@R.query(
    "tk4_label_samples",
    """SELECT label, rn AS position, email_id, CASE WHEN length(body) > 500 THEN substr(body, 1, 500) || '...' ELSE body END AS sample
    FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY email_id) AS rn FROM emails WHERE label IN (0, 1))
    WHERE rn <= CASE WHEN label = 1 THEN 3 ELSE 1 END""",
)
def label_samples(spark, sf):
    return analytics.label_samples(fx.emails(spark, sf), {1: 3, 0: 1})


# ----------------------------------------------------------------------- profile
_PROFILED = ["text", "lang", "source", "role", "turn", "dataset"]
_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", count({n}) AS filled, count(DISTINCT {n}) AS distinct_values, "
    f"{o.r6(f'avg(length({n}::VARCHAR))')} AS mean_chars FROM h"
    for n in _PROFILED
)


@R.query(
    "ag19_column_profile",
    f"""SELECT * FROM (WITH h AS (SELECT text, lang, source, 'documents' AS dataset, NULL::VARCHAR AS role, NULL::BIGINT AS turn FROM documents
      UNION ALL SELECT text, NULL, NULL, 'conversations', role, turn FROM conversations
      UNION ALL SELECT text, NULL, NULL, 'benchmark', NULL, NULL FROM benchmark) {_PROFILE_SQL})""",
)
def column_profile(spark, sf):
    return schema.profile(history(spark, sf)).withColumn("mean_chars", risk.round6(F.col("mean_chars")))


@R.query(
    "prj4_auto_detect",
    """SELECT (SELECT n FROM (SELECT 'payload' AS n, avg(length(text)) AS a, 1 AS i FROM documents UNION ALL SELECT 'lang', avg(length(lang)), 2 FROM documents
        UNION ALL SELECT 'source', avg(length(source)), 3 FROM documents) ORDER BY a DESC, i LIMIT 1) AS text_column,
      (SELECT n FROM (SELECT 'doc_id' AS n, count(DISTINCT doc_id) AS k, 1 AS i FROM documents UNION ALL SELECT 'n_chars', count(DISTINCT n_chars), 2 FROM documents
        UNION ALL SELECT 'quality', count(DISTINCT quality), 3 FROM labels UNION ALL SELECT 'toxic', count(DISTINCT toxic), 4 FROM labels)
        WHERE k <= 10 ORDER BY i LIMIT 1) AS label_column""",
)
def auto_detect(spark, sf):
    """No column has a usual name, so the data decides."""
    docs = fx.table(spark, sf, "documents").select("doc_id", F.col("text").alias("payload"), "lang", "source", "n_chars")
    text, label = schema.auto_detect(docs.join(fx.table(spark, sf, "labels"), "doc_id", "left"))
    n_rows = docs.agg(F.count("*").alias("n"))
    return n_rows.select(F.lit(text).alias("text_column"), F.lit(label).alias("label_column"))
