"""Registered queries: intake, dataset memory, store, history, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscore import constants as c
from mailscore.functions import risk
from mailscore.operators import ranking, scoring, store
from mailscore.plans import oracle as o
from mailscore.plans.queries_features import texts
from mailscore.plans.registry import R
from mailscore.session import ensure_checkpoint_dir
from mailscore.sources import fixtures as fx
from mailscore.sources import memory, messages
from mailscore.sources.message_store import MessageStore
from mailscore.streaming import jobs

EMAIL = ["email_id", "user_id", "message_id"]


# ------------------------------------------------------------------------ memory
@R.query(
    "src7_row_fingerprint",
    "SELECT doc_id, substr(sha256(concat_ws('|', doc_id::VARCHAR, lang, text)), 1, 16) AS fingerprint FROM documents",
)
def row_fingerprint(spark, sf):
    df = fx.table(spark, sf, "documents")
    return df.select("doc_id", memory.row_fingerprint(F.col("doc_id").cast("string"), "lang", "text").alias("fingerprint"))


def _digests(df: DataFrame, name, text: str = "text") -> DataFrame:
    rows = df.select(name.alias("dataset"), F.sha2(text, 256).alias("sha"))
    return rows.groupBy("dataset").agg(memory.multiset_digest(F.col("sha")).alias("fingerprint"))


def incoming_sets(spark, sf) -> DataFrame:
    """Documents by source and by language, and conversations by role, as data sets."""
    docs, conv = fx.table(spark, sf, "documents"), fx.table(spark, sf, "conversations")
    sets = _digests(docs, F.concat(F.lit("source:"), "source"))
    sets = sets.unionByName(_digests(docs, F.concat(F.lit("lang:"), "lang")))
    return sets.unionByName(_digests(conv, F.concat(F.lit("role:"), "role")))


def known_sets(spark, sf) -> DataFrame:
    return _digests(fx.table(spark, sf, "documents"), F.concat(F.lit("old:"), "lang"))


def _digest_sql(name: str, table: str) -> str:
    sums = ", ".join(
        f"sum(('0x' || substr(s, {1 + 15 * i}, 15))::BIGINT)::HUGEINT::VARCHAR" for i in range(4)
    )
    return (
        f"SELECT {name} AS dataset, substr(sha256(concat_ws('|', count(*)::VARCHAR, {sums})), 1, 16) AS fingerprint "
        f"FROM (SELECT *, sha256(text) AS s FROM {table}) GROUP BY 1"
    )


INCOMING_SQL = " UNION ALL ".join(
    [_digest_sql("'source:' || source", "documents"), _digest_sql("'lang:' || lang", "documents"), _digest_sql("'role:' || role", "conversations")]
)
KNOWN_SQL = _digest_sql("'old:' || lang", "documents")


@R.query(
    "src8_dataset_memory",
    f"""SELECT dataset, fingerprint, CASE WHEN fingerprint IN (SELECT fingerprint FROM ({KNOWN_SQL})) THEN '[SKIP]'
    WHEN dataset > min(dataset) OVER (PARTITION BY fingerprint) THEN '[SKIP]' ELSE '[CACHE]' END AS status FROM ({INCOMING_SQL})""",
)
def dataset_memory(spark, sf):
    return memory.with_status(incoming_sets(spark, sf), known_sets(spark, sf))


@R.query(
    "set3_new_datasets",
    f"SELECT dataset, fingerprint FROM ({INCOMING_SQL}) WHERE fingerprint NOT IN (SELECT fingerprint FROM ({KNOWN_SQL}))",
)
def new_datasets(spark, sf):
    return memory.unseen(incoming_sets(spark, sf), known_sets(spark, sf)).select("dataset", "fingerprint")


def history(spark, sf) -> DataFrame:
    """Three data sets with differing columns as one."""
    docs = fx.table(spark, sf, "documents").select("text", "lang", "source", F.lit("documents").alias("dataset"))
    conv = fx.table(spark, sf, "conversations").select("text", "role", "turn", F.lit("conversations").alias("dataset"))
    bench = fx.table(spark, sf, "benchmark").select("text", F.lit("benchmark").alias("dataset"))
    return docs.unionByName(conv, allowMissingColumns=True).unionByName(bench, allowMissingColumns=True)


HISTORY_SQL = (
    "SELECT text, lang, source, 'documents' AS dataset, NULL::VARCHAR AS role, NULL::BIGINT AS turn FROM documents UNION ALL "
    "SELECT text, NULL, NULL, 'conversations', role, turn FROM conversations UNION ALL "
    "SELECT text, NULL, NULL, 'benchmark', NULL, NULL FROM benchmark"
)


@R.query(
    "src9_history_by_name",
    f"""SELECT dataset, coalesce(lang, '') AS lang, coalesce(role, '') AS role, coalesce(turn, -1) AS turn,
      substr(sha256(text), 1, 16) AS fingerprint FROM ({HISTORY_SQL})""",
)
def history_by_name(spark, sf):
    return history(spark, sf).select(
        "dataset",
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("turn", F.lit(-1)).alias("turn"),
        memory.row_fingerprint("text").alias("fingerprint"),
    )


@R.query(
    "set1_union_by_name",
    f"""SELECT dataset, count(*) AS n, count(lang) AS langs, count(role) AS roles, count(turn) AS turns,
      sum(length(text))::BIGINT AS chars FROM ({HISTORY_SQL}) GROUP BY dataset""",
)
def union_by_name(spark, sf):
    return history(spark, sf).groupBy("dataset").agg(
        F.count("*").alias("n"),
        F.count("lang").alias("langs"),
        F.count("role").alias("roles"),
        F.count("turn").alias("turns"),
        F.sum(F.length("text")).alias("chars"),
    )


# ---------------------------------------------------------------------- messages
def payloads(spark, sf) -> DataFrame:
    """Every email as the JSON a mail provider would deliver, in four shapes."""
    e = fx.received(fx.text_emails(spark, sf))
    data = F.translate(F.base64(F.encode("body", "UTF-8")), "+/", "-_")
    other = F.translate(F.base64(F.encode(F.coalesce("subject", F.lit("-")), "UTF-8")), "+/", "-_")

    def part(kind: str, content):
        return F.struct(F.lit(kind).alias("mimeType"), F.struct(content.alias("data")).alias("body"))

    def head(name: str, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    shape = F.pmod("email_id", F.lit(4))
    parts = (
        F.when(shape == 0, F.array(part("text/plain", data), part("text/html", other)))
        .when(shape == 1, F.array(part("text/html", other), part("text/plain", data)))
        .when(shape == 2, F.array(part("image/png", other), part("text/html", data)))
    )
    date = F.concat(F.date_format("received_at", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    payload = F.struct(
        F.when(shape == 3, F.lit("text/plain")).otherwise(F.lit("multipart/mixed")).alias("mimeType"),
        F.array(
            head("Subject", F.lit("overwritten")),
            head("Subject", F.coalesce("subject", F.lit(""))),
            head("From", F.col("sender")),
            head("Date", date),
        ).alias("headers"),
        F.struct(F.when(shape == 3, data).alias("data")).alias("body"),
        parts.alias("parts"),
    )
    return e.select("email_id", F.to_json(F.struct(F.col("message_id").alias("id"), payload.alias("payload"))).alias("payload_json"))


_BODY_SQL = """CASE email_id % 4 WHEN 1 THEN concat(coalesce(subject, '-'), body) ELSE body END"""


@R.query(
    "src13_flatten_messages",
    f"""SELECT email_id, message_id, coalesce(subject, '') AS subject, sender, '' AS recipient, {_BODY_SQL} AS body
    FROM emails""",
)
def flatten_messages(spark, sf):
    flat = messages.flatten_messages(payloads(spark, sf), keep=("email_id",))
    return messages.split_rejects(flat)[0].drop("received_at")


@R.query("sc26_mime_body", f"SELECT email_id, length(b) AS chars, sha256(b) AS sha FROM (SELECT email_id, {_BODY_SQL} AS b FROM emails)")
def mime_body(spark, sf):
    flat = messages.flatten_messages(payloads(spark, sf), keep=("email_id",))
    return flat.select("email_id", F.length("body").alias("chars"), F.sha2("body", 256).alias("sha"))


@R.query("sc27_mail_date", "SELECT email_id, strftime(received_at, '%Y-%m-%d %H:%M:%S') AS received_at FROM received")
def mail_date(spark, sf):
    flat = messages.flatten_messages(payloads(spark, sf), keep=("email_id",))
    return flat.select("email_id", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("received_at"))


@R.query("sc28_headers", "SELECT email_id, coalesce(subject, '') AS subject, sender, '' AS recipient FROM emails")
def headers(spark, sf):
    return messages.flatten_messages(payloads(spark, sf), keep=("email_id",)).select("email_id", "subject", "sender", "recipient")


@R.query(
    "src17_ad_hoc_emails",
    """SELECT DISTINCT user_id, 'manual_' || substr(sha256(concat_ws('|', user_id::VARCHAR, text)), 1, 16) AS message_id,
      'Manual Analysis' AS subject, '' AS sender, '' AS recipient, text AS body
    FROM (SELECT conv_id AS user_id, text FROM conversations)""",
)
def ad_hoc_emails(spark, sf):
    asked = fx.table(spark, sf, "conversations").select(F.col("conv_id").alias("user_id"), "text")
    return messages.ad_hoc_emails(asked)


# ------------------------------------------------------------------------- store
@R.query(
    "src14_keyed_insert",
    """SELECT email_id, user_id, message_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, message_id ORDER BY email_id) AS rn
      FROM emails) WHERE rn = 1 AND (user_id, message_id) NOT IN (SELECT (user_id, message_id) FROM emails WHERE label IS NOT NULL)""",
)
def keyed_insert(spark, sf):
    """All emails arrive; those with a label are taken to be stored already."""
    e = fx.emails(spark, sf)
    return store.keyed_insert(e, e.where(F.col("label").isNotNull())).select(*EMAIL)


@R.query(
    "src14_first_arrivals",
    "SELECT user_id, message_id, min(email_id) AS email_id FROM emails GROUP BY user_id, message_id",
)
def first_arrivals(spark, sf):
    return store.first_arrivals(fx.emails(spark, sf)).select(*EMAIL)


@R.query(
    "src14_resolved_ids",
    """SELECT email_id, coalesce(min(email_id) FILTER (label IS NOT NULL) OVER w, min(email_id) OVER w) AS stored_email_id
      FROM emails WINDOW w AS (PARTITION BY user_id, message_id)""",
)
def resolved_ids(spark, sf):
    """All emails arrive; those with a label are stored already, under the ids they have."""
    e = fx.emails(spark, sf)
    stored = e.where(F.col("label").isNotNull()).select(*EMAIL)
    return store.resolve_insert(e.select(*EMAIL), stored).select("email_id", "stored_email_id")


@R.query(
    "jn1_user_predictions",
    "SELECT p.prediction_id, p.email_id, e.user_id, p.prediction FROM predictions p JOIN emails e USING (email_id)",
)
def user_predictions(spark, sf):
    joined = store.user_predictions(fx.predictions(spark, sf), fx.emails(spark, sf))
    return joined.select("prediction_id", "email_id", "user_id", "prediction")


LATEST = "prediction_id, prediction, probability, model_version"


@R.query(
    "jn2_email_with_latest",
    f"""SELECT e.email_id, e.user_id, coalesce(l.prediction_id, -1) AS prediction_id, coalesce(l.prediction, -1) AS prediction,
      coalesce({o.r6('l.probability')}, -1) AS probability, coalesce(l.model_version, '') AS model_version
    FROM emails e LEFT JOIN latest l USING (email_id)""",
)
def email_with_latest(spark, sf):
    df = store.with_latest_prediction(fx.emails(spark, sf), fx.predictions(spark, sf))
    return df.select(
        "email_id",
        "user_id",
        F.coalesce("prediction_id", F.lit(-1)).alias("prediction_id"),
        F.coalesce("prediction", F.lit(-1)).alias("prediction"),
        F.coalesce(risk.round6(F.col("probability")), F.lit(-1.0)).alias("probability"),
        F.coalesce("model_version", F.lit("")).alias("model_version"),
    )


@R.query(
    "jn3_history_with_email",
    """SELECT p.prediction_id, p.email_id, coalesce(e.subject, '') AS subject, coalesce(e.sender, '') AS sender
    FROM predictions p LEFT JOIN emails e USING (email_id)""",
)
def history_with_email(spark, sf):
    df = store.history_with_email(fx.predictions(spark, sf), fx.emails(spark, sf), ["subject", "sender"])
    return df.select(
        "prediction_id", "email_id", F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("sender", F.lit("")).alias("sender")
    )


@R.query(
    "jn4_unseen_messages",
    """SELECT email_id, user_id, message_id FROM emails e
    WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.email_id = e.email_id AND p.prediction = 1)""",
)
def unseen_messages(spark, sf):
    """Emails that no prediction has flagged."""
    flagged = fx.predictions(spark, sf).where(F.col("prediction") == 1)
    return store.missing_from(fx.emails(spark, sf), flagged, ["email_id"]).select(*EMAIL)


@R.query("jn4_orphan_predictions", "SELECT prediction_id, email_id FROM predictions WHERE email_id NOT IN (SELECT email_id FROM emails)")
def orphan_predictions(spark, sf):
    return store.orphans(fx.predictions(spark, sf), fx.emails(spark, sf)).select("prediction_id", "email_id")


@R.query(
    "jn5_selected_emails",
    "SELECT email_id, user_id, message_id FROM emails WHERE email_id IN (SELECT email_id FROM predictions WHERE model_version = 'v1')",
)
def selected_emails(spark, sf):
    selected = fx.predictions(spark, sf).where(F.col("model_version") == "v1")
    return store.select_emails(fx.emails(spark, sf), selected).select(*EMAIL)


def requests(spark, sf) -> DataFrame:
    """Analysis requests: an email id, which may not exist, and the user who asks."""
    events = fx.table(spark, sf, "events")
    return events.select(
        F.col("event_id").alias("request_id"),
        (F.col("event_id") % 1200).alias("email_id"),
        (F.col("user_id") % 50).alias("user_id"),
    )


REQUESTS = "(SELECT event_id AS request_id, event_id % 1200 AS email_id, user_id % 50 AS user_id FROM events)"
OUTCOME_SQL = f"""SELECT r.request_id, r.email_id, r.user_id, CASE WHEN e.user_id IS NULL THEN 'not found'
  WHEN e.user_id <> r.user_id THEN 'access denied' ELSE 'ok' END AS outcome FROM {REQUESTS} r LEFT JOIN emails e USING (email_id)"""


@R.query(
    "jn8_owned_requests",
    f"SELECT r.* FROM {REQUESTS} r JOIN emails e ON r.email_id = e.email_id AND r.user_id = e.user_id",
)
def owned_requests(spark, sf):
    return store.split_owned(requests(spark, sf), fx.emails(spark, sf))[0].select("request_id", "email_id", "user_id")


@R.query("jn8_request_outcome", OUTCOME_SQL)
def request_outcome(spark, sf):
    return store.request_outcome(requests(spark, sf), fx.emails(spark, sf)).select("request_id", "email_id", "user_id", "outcome")


@R.query(
    "ag18_bulk_outcome",
    f"""SELECT count(*) AS completed, count_if(outcome = 'ok')::BIGINT AS successful, count_if(outcome <> 'ok')::BIGINT AS failed
    FROM ({OUTCOME_SQL})""",
)
def bulk_outcome(spark, sf):
    return scoring.outcome_counts(store.request_outcome(requests(spark, sf), fx.emails(spark, sf)))


# Requests for any email of the store, and for some that it does not hold.
ALL_REQUESTS = """(SELECT event_id AS request_id, event_id % (n + 1 + n // 20) AS email_id, user_id % 50 AS user_id
    FROM events, (SELECT count(*) AS n FROM documents))"""
ALL_OUTCOMES_SQL = OUTCOME_SQL.replace(REQUESTS, ALL_REQUESTS)


def all_requests(spark, sf) -> DataFrame:
    n = fx.table(spark, sf, "documents").agg(F.count("*").alias("n")).scalar()
    return fx.table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        F.pmod("event_id", n + 1 + F.floor(n / 20)).alias("email_id"),
        F.pmod("user_id", F.lit(50)).alias("user_id"),
    )


@R.query("jn8_outcome_of_any_email", ALL_OUTCOMES_SQL)
def outcome_of_any_email(spark, sf):
    return store.request_outcome(all_requests(spark, sf), fx.emails(spark, sf)).select("request_id", "email_id", "user_id", "outcome")


@R.query(
    "jn8_owned_of_any_email",
    f"SELECT r.* FROM {ALL_REQUESTS} r JOIN emails e ON r.email_id = e.email_id AND r.user_id = e.user_id",
)
def owned_of_any_email(spark, sf):
    return store.split_owned(all_requests(spark, sf), fx.emails(spark, sf))[0].select("request_id", "email_id", "user_id")


@R.query(
    "ag18_outcome_over_all_emails",
    f"""SELECT count(*) AS completed, count_if(outcome = 'ok')::BIGINT AS successful, count_if(outcome <> 'ok')::BIGINT AS failed
    FROM ({ALL_OUTCOMES_SQL})""",
)
def outcome_over_all_emails(spark, sf):
    return scoring.outcome_counts(store.request_outcome(all_requests(spark, sf), fx.emails(spark, sf)))


@R.query("ag11_emails_per_user", "SELECT user_id, count(*) AS n_emails FROM emails GROUP BY user_id")
def emails_per_user(spark, sf):
    return store.emails_per_user(fx.emails(spark, sf))


_BUSIEST = "(SELECT user_id FROM emails GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)"


def busiest_user(emails: DataFrame):
    counts = store.emails_per_user(emails)
    return counts.orderBy(F.col("n_emails").desc(), "user_id").limit(1).select("user_id").scalar()


@R.query("flt6_emails_of_user", f"SELECT email_id, user_id, message_id FROM emails WHERE user_id = {_BUSIEST}")
def emails_of_user(spark, sf):
    """The emails of the user who has most."""
    e = fx.emails(spark, sf)
    return store.of_user(e, busiest_user(e)).select(*EMAIL)


@R.query(
    "flt7_lookup",
    """SELECT email_id, user_id, message_id FROM emails e WHERE EXISTS (SELECT 1 FROM conversations c
      WHERE c.conv_id % 50 = e.user_id AND 'msg-' || c.conv_id = e.message_id)""",
)
def lookup(spark, sf):
    """Emails by (user, message id), for all keys asked for at once."""
    keys = fx.table(spark, sf, "conversations").select(
        (F.col("conv_id") % 50).alias("user_id"), F.concat(F.lit("msg-"), F.col("conv_id").cast("string")).alias("message_id")
    )
    return store.lookup(fx.emails(spark, sf), keys, store.MESSAGE_KEY).select(*EMAIL)


# ----------------------------------------------------------------- pages, history
@R.query("wn1_latest_prediction", f"SELECT email_id, prediction_id, prediction, {o.r6('probability')} AS probability, model_version, created_at FROM latest")
def latest_prediction(spark, sf):
    df = store.latest_predictions(fx.predictions(spark, sf)).withColumn("probability", risk.round6(F.col("probability")))
    return df.select("email_id", "prediction_id", "prediction", "probability", "model_version", "created_at")


@R.query(
    "wn2_prediction_history",
    """SELECT prediction_id, email_id, row_number() OVER (PARTITION BY email_id ORDER BY created_at DESC, prediction_id DESC) AS history_rank
    FROM predictions""",
)
def prediction_history(spark, sf):
    return store.prediction_history(fx.predictions(spark, sf)).select("prediction_id", "email_id", "history_rank")


@R.query(
    "wn3_email_pages",
    """SELECT email_id, user_id, received_at, rn AS position FROM (SELECT *, row_number() OVER
      (PARTITION BY user_id ORDER BY received_at DESC, email_id DESC) AS rn FROM received) WHERE rn BETWEEN 6 AND 55""",
)
def email_pages(spark, sf):
    df = store.email_pages(fx.received(fx.emails(spark, sf)), offset=5)
    return df.select("email_id", "user_id", "received_at", "position")


@R.query(
    "wn3_email_page",
    f"SELECT email_id, user_id, received_at FROM received WHERE user_id = {_BUSIEST} ORDER BY received_at DESC, email_id DESC LIMIT 10 OFFSET 5",
)
def email_page(spark, sf):
    e = fx.received(fx.emails(spark, sf))
    return store.email_page(e, busiest_user(e), 10, 5).select("email_id", "user_id", "received_at")


@R.query(
    "wn4_prediction_pages",
    """SELECT prediction_id, user_id, rn AS position FROM (SELECT p.prediction_id, e.user_id, row_number() OVER
      (PARTITION BY e.user_id ORDER BY p.created_at DESC, p.prediction_id DESC) AS rn
      FROM predictions p JOIN emails e USING (email_id)) WHERE rn <= 100""",
)
def prediction_pages(spark, sf):
    df = store.prediction_pages(fx.predictions(spark, sf), fx.emails(spark, sf))
    return df.select("prediction_id", "user_id", "position")


@R.query(
    "jn1_prediction_page",
    f"""SELECT p.prediction_id, p.email_id FROM predictions p JOIN emails e USING (email_id) WHERE e.user_id = {_BUSIEST}
    ORDER BY p.created_at DESC, p.prediction_id DESC LIMIT 100 OFFSET 3""",
)
def prediction_page(spark, sf):
    e = fx.emails(spark, sf)
    return store.prediction_page(fx.predictions(spark, sf), e, busiest_user(e), 100, 3).select("prediction_id", "email_id")


@R.query(
    "sc29_email_report",
    """SELECT r.email_id, CASE WHEN length(r.subject) > 0 THEN r.subject ELSE '(No Subject)' END AS subject, r.sender,
      strftime(r.received_at, '%Y-%m-%d') AS day,
      CASE WHEN l.prediction IS NULL THEN 'Not Analyzed' WHEN l.prediction = 1 THEN 'Phishing' ELSE 'Benign' END AS badge,
      coalesce(format('{:.2f}%', l.probability * 100), '') AS confidence FROM received r LEFT JOIN latest l USING (email_id)""",
)
def email_report(spark, sf):
    return store.email_report(fx.received(fx.emails(spark, sf)), fx.predictions(spark, sf))


@R.query(
    "sc29_history_report",
    """SELECT p.prediction_id, CASE WHEN e.email_id IS NULL THEN 'N/A' WHEN length(e.subject) > 0 THEN e.subject ELSE '(No Subject)' END AS subject,
      CASE WHEN e.email_id IS NULL THEN 'N/A' ELSE coalesce(e.sender, '') END AS sender,
      CASE WHEN p.prediction = 1 THEN 'Phishing' ELSE 'Benign' END AS badge, format('{:.2f}%', p.probability * 100) AS confidence,
      strftime(p.created_at, '%Y-%m-%d') AS day FROM predictions p LEFT JOIN emails e USING (email_id)""",
)
def history_report(spark, sf):
    return store.history_report(fx.predictions(spark, sf), fx.emails(spark, sf))


# --------------------------------------------------------------------- streaming
@R.query(
    "st2_stream_dedupe",
    "SELECT DISTINCT user_id, event_type AS message_id FROM events",
)
def stream_dedupe(spark, sf):
    """Events as a message stream; the watermark covers the data, so the result equals the batch one."""
    run = f"{ensure_checkpoint_dir(spark)}/st2-{uuid.uuid4().hex}"
    static = fx.table(spark, sf, "events")
    stream = (
        spark.readStream.schema(static.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
        .select("user_id", F.col("event_type").alias("message_id"), F.col("ts").cast("timestamp").alias("received_at"))
    )
    query = jobs.append_stream(jobs.deduplicate(stream, "3650 days"), f"{run}/out", f"{run}/state")
    query.awaitTermination()
    return spark.read.schema("user_id bigint, message_id string").parquet(f"{run}/out")


@R.query(
    "st2_stream_to_store",
    """SELECT user_id, message_id, arg_min(email_id, email_id % 3 * 1000000000000 + email_id) AS email_id
      FROM emails GROUP BY user_id, message_id""",
)
def stream_to_store(spark, sf):
    """All emails arrive in three deliveries, each by a stream that starts anew; copies in a later one are recognised."""
    run = f"{ensure_checkpoint_dir(spark)}/st2-{uuid.uuid4().hex}"
    arriving = fx.emails(spark, sf).select("user_id", "message_id", "email_id")
    into = MessageStore(spark, f"{run}/store", arriving.schema)
    for delivery in range(3):
        arriving.where(F.pmod("email_id", F.lit(3)) == delivery).write.mode("append").parquet(f"{run}/in")
        stream = spark.readStream.schema(arriving.schema).parquet(f"{run}/in")
        jobs.store_stream(stream, into, f"{run}/state").awaitTermination()
    return into.rows()


@R.query(
    "src14_resolved_in_store",
    """SELECT email_id, coalesce(min(email_id) FILTER (label IS NOT NULL) OVER w, min(email_id) OVER w) AS stored_email_id
      FROM emails WINDOW w AS (PARTITION BY user_id, message_id)""",
)
def resolved_in_store(spark, sf):
    """As src14_resolved_ids, the stored emails in buckets on disk."""
    e = fx.emails(spark, sf)
    arriving = e.select("user_id", "message_id", "email_id")
    into = MessageStore(spark, f"{ensure_checkpoint_dir(spark)}/src14-{uuid.uuid4().hex}", arriving.schema)
    into.insert(e.where(F.col("label").isNotNull()), "labelled")
    return into.resolve(arriving).select("email_id", "stored_email_id")
