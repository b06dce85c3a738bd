"""Email and prediction tables derived from the general test tables.

The recipe is SQL text so that the same rows can be produced by another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailscore.sources.readers import spread

EMAILS_SQL = """
SELECT d.doc_id AS email_id,
  CAST((d.doc_id - d.doc_id % 20) / 20 AS BIGINT) % 50 AS user_id,
  concat('msg-', CAST(CASE WHEN d.doc_id % 20 = 19 THEN d.doc_id - 1 ELSE d.doc_id END AS VARCHAR(20))) AS message_id,
  CASE d.doc_id % 5 WHEN 0 THEN 'Urgent: verify your account' WHEN 1 THEN 'Team meeting'
    WHEN 2 THEN 'You are a winner!' WHEN 3 THEN NULL ELSE 'Invoice attached' END AS subject,
  concat('from: user', CAST(d.doc_id % 97 AS VARCHAR(20)), '@',
    CASE d.doc_id % 8 WHEN 0 THEN 'linkedin.com' WHEN 1 THEN 'mail.google.com' WHEN 2 THEN 'secure-login.xyz'
      WHEN 3 THEN 'phishing-linkedin.com' WHEN 4 THEN 'shop.top' WHEN 5 THEN 'example.org'
      WHEN 6 THEN 'My-Bank.biz' ELSE 'corp.example.com' END) AS sender,
  concat(
    CASE WHEN d.doc_id % 8 = 7 THEN '' ELSE concat('From: user', CAST(d.doc_id % 97 AS VARCHAR(20)), '@',
      CASE d.doc_id % 8 WHEN 0 THEN 'linkedin.com' WHEN 1 THEN 'mail.google.com' WHEN 2 THEN 'secure-login.xyz'
        WHEN 3 THEN 'phishing-linkedin.com' WHEN 4 THEN 'shop.top' WHEN 5 THEN 'example.org'
        ELSE 'My-Bank.biz' END, chr(10)) END,
    d.text, chr(10),
    CASE d.doc_id % 7 WHEN 0 THEN 'Please verify your account within 24 hours or it will be suspended!'
      WHEN 1 THEN 'Click here to claim your free prize of $1000!!'
      WHEN 2 THEN 'Please find attached the report.pdf' ELSE '' END, chr(10),
    CASE WHEN d.doc_id % 3 = 0 THEN 'https://www.linkedin.com/jobs/view/1 ' ELSE '' END,
    CASE WHEN d.doc_id % 4 = 0 THEN 'HTTP://phish.example.xyz:8080/a?b=c ' ELSE '' END,
    CASE WHEN d.doc_id % 9 = 0 THEN 'www.google.com/x https://a.b.top#f http://c.d.com/1 http://c.d.com/2 '
      ELSE '' END) AS body,
  d.lang AS lang, d.source AS source, l.toxic AS label
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

PREDICTIONS_SQL = """
SELECT event_id AS prediction_id, CASE WHEN event_id % n % 20 = 13 THEN n + event_id % 50 ELSE event_id % n END AS email_id,
  CASE WHEN event_type IN ('error','purchase') THEN 1 ELSE 0 END AS prediction,
  value - floor(value) AS probability,
  concat('v', CAST(event_id % 3 AS VARCHAR(20))) AS model_version, ts AS created_at
FROM (SELECT event_id, event_type, value, ts, (SELECT count(*) FROM {documents}) AS n FROM {events})
"""

# Labels as people write them, for the label operators.
RAW_LABELS_SQL = """
SELECT d.doc_id AS email_id, d.text AS body,
  CASE d.doc_id % 13
    WHEN 0 THEN CASE WHEN l.toxic = 1 THEN ' Phishing ' ELSE 'Legitimate' END
    WHEN 1 THEN CASE WHEN l.toxic = 1 THEN 'SPAM' ELSE 'ham' END
    WHEN 2 THEN CASE WHEN l.toxic = 1 THEN '1' ELSE '0' END
    WHEN 3 THEN CASE WHEN l.toxic = 1 THEN '1.0' ELSE '0.0' END
    WHEN 4 THEN CASE WHEN l.toxic = 1 THEN 'true' ELSE 'No' END
    WHEN 5 THEN '2'
    WHEN 6 THEN 'see body'
    WHEN 7 THEN '0.5'
    WHEN 8 THEN '-3'
    WHEN 9 THEN '1f'
    WHEN 10 THEN NULL
    ELSE CAST(l.toxic AS VARCHAR(20)) END AS raw_label
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are to be worked on, by all cores."""
    return spread(table(spark, sf_dir, name))


def emails(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """email_id, user_id, message_id, subject, sender, body, lang, source, label."""
    documents = table(spark, sf_dir, "documents") if documents is None else documents
    return spark.sql(EMAILS_SQL, documents=documents, labels=table(spark, sf_dir, "labels"))


def text_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`emails`, for work on the texts."""
    return emails(spark, sf_dir, text_table(spark, sf_dir, "documents"))


def received(df: DataFrame) -> DataFrame:
    """Adds received_at: one email a minute."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return df.withColumn("received_at", F.timestamp_add("MINUTE", F.col("email_id"), start))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prediction_id, email_id, prediction, probability, model_version, created_at.

    Ids run over all emails; one email in twenty has no prediction, and the predictions meant for it belong to emails
    that are gone.
    """
    return spark.sql(PREDICTIONS_SQL, events=table(spark, sf_dir, "events"), documents=table(spark, sf_dir, "documents"))


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """email_id, body, raw_label."""
    return spark.sql(
        RAW_LABELS_SQL, documents=table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels")
    )
