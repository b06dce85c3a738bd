"""Registered queries: text features, risks, scores, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscore import constants as c
from mailscore.functions import risk
from mailscore.functions import text as tx
from mailscore.operators import quality, schema, scoring, store, trust
from mailscore.operators.once import explode_once
from mailscore.plans import oracle as o
from mailscore.plans.registry import R
from mailscore.sources import fixtures as fx
from mailscore.sources import sinks

TEXTS = "email_id, text"


def texts(spark, sf) -> DataFrame:
    """Emails with subject and body as one text."""
    return fx.text_emails(spark, sf).withColumn("text", tx.join_subject(F.col("subject"), F.col("body")))


def risks(spark, sf, use_link_domains: bool = True) -> DataFrame:
    """Every email with features and risks, the probability being that of the latest prediction, if there is one.

    The features are taken before the join, so that no text travels.
    """
    latest = store.latest_predictions(
        fx.predictions(spark, sf).select("email_id", "prediction_id", "probability", "created_at")
    )
    features = scoring.extract_features(texts(spark, sf).select("email_id", "text")).drop("text")
    joined = features.join(latest.select("email_id", "probability"), "email_id", "left")
    return scoring.add_risks(joined, use_link_domains=use_link_domains)


def scored(spark, sf) -> DataFrame:
    return scoring.add_verdict(risks(spark, sf))


def _feature(name: str, expression, check: str) -> None:
    """Registers one feature over all emails."""

    def run(spark, sf):
        df = schema.with_shared(texts(spark, sf), "text")
        return df.select("email_id", expression(F.col("text"), "_lower", F.col("_urls")).alias("value"))

    R.query(name, f"SELECT email_id, {check} AS value FROM feat")(run)


_feature("sc3_url_count", lambda t, lo, u: tx.url_count(u), "links_count")
_feature("sc4_has_url", lambda t, lo, u: tx.has_url(u), "(links_count > 0)::INT")
_feature("sc5_exclamation_count", lambda t, lo, u: tx.exclamation_count(t), "exclamation_count")
_feature("sc6_char_count", lambda t, lo, u: tx.char_count(t), "body_length")
_feature("sc7_urgent_flag", lambda t, lo, u: tx.urgent_flag(lo), "urgent_keywords")
_feature("sc8_urgent_count", lambda t, lo, u: tx.urgent_count(lo), "urgent_count")
_feature("sc9_attachment_flag", lambda t, lo, u: tx.attachment_flag(lo), "has_attachment")
_feature("sc10_sender_domain", lambda t, lo, u: tx.sender_domain(t), "sender_domain")
_feature(
    "sc11_link_domains", lambda t, lo, u: F.array_join(tx.link_domains(u), ","), "array_to_string(link_domains, ',')"
)
_feature(
    "set2_distinct_in_order",
    lambda t, lo, u: F.array_join(F.array_distinct(u), " "),
    "array_to_string(list_filter(urls, lambda u, i: list_position(urls, u) = i), ' ')",
)
_feature(
    "jn7_keyword_containment",
    lambda t, lo, u: F.array_join(tx.contained_words(lo, c.URGENT_KEYWORDS + c.ATTACHMENT_KEYWORDS), ","),
    f"array_to_string(list_filter({o.list_of(c.URGENT_KEYWORDS + c.ATTACHMENT_KEYWORDS)}, lambda k: contains(lt, k)), ',')",
)
_feature(
    "tk6_first_keywords",
    lambda t, lo, u: F.array_join(F.slice(tx.contained_words(lo, c.URGENT_KEYWORDS), 1, 3), ","),
    f"array_to_string((list_filter({o.list_of(c.URGENT_KEYWORDS)}, lambda k: contains(lt, k)))[1:3], ',')",
)
_feature(
    "tk7_first_address",
    lambda t, lo, u: F.coalesce(tx.first_address(t), F.lit("")),
    f"regexp_extract(text, {o.quoted(c.ADDRESS_RE)}, 0)",
)


@R.query("sc1_strip_html", f"SELECT page_id, {o.html_text('html')} AS text FROM pages")
def strip_html(spark, sf):
    return fx.text_table(spark, sf, "pages").select("page_id", tx.strip_html(F.col("html")).alias("text"))


@R.query("sc2_normalize_text", f"SELECT page_id, {o.normal_text('html')} AS text FROM pages")
def normalize_text(spark, sf):
    return fx.text_table(spark, sf, "pages").select("page_id", tx.normalize_text(F.col("html")).alias("text"))


@R.query("sc2_normalize_emails", f"SELECT email_id, {o.normal_text('body')} AS text FROM emails")
def normalize_emails(spark, sf):
    return fx.text_emails(spark, sf).select("email_id", tx.normalize_text(F.col("body")).alias("text"))


@R.query("prj8_subject_and_body", "SELECT email_id, text FROM texts")
def subject_and_body(spark, sf):
    return texts(spark, sf).select("email_id", "text")


@R.query(
    "prj2_text_column",
    "SELECT doc_id, CASE WHEN lang IS NOT NULL OR text IS NOT NULL THEN concat_ws(' ', lang, text) END AS text FROM documents",
)
def text_column(spark, sf):
    """A table with subject and email_text and no preferred column."""
    named = fx.table(spark, sf, "documents").select("doc_id", F.col("lang").alias(" Subject"), F.col("text").alias("Email_Text "))
    df = schema.normalize_columns(named)
    return df.select("doc_id", schema.text_expression(df, "body").alias("text"))


FEATURES = "has_attachment, links_count, urgent_keywords, body_length, exclamation_count, sender_domain"


@R.query("prj5_feature_columns", f"SELECT email_id, {FEATURES} FROM feat")
def feature_columns(spark, sf):
    df = schema.ensure_features(texts(spark, sf), "text")
    return df.select("email_id", *FEATURES.split(", "))


@R.query(
    "prj5_keeps_given_columns",
    f"""SELECT email_id, has_attachment, coalesce(label, 0) AS links_count, urgent_keywords, body_length,
      exclamation_count, coalesce(subject, 'unknown') AS sender_domain FROM feat""",
)
def keeps_given_columns(spark, sf):
    given = texts(spark, sf).withColumns({"links_count": F.col("label"), "sender_domain": F.col("subject")})
    return schema.ensure_features(given, "text").select("email_id", *FEATURES.split(", "))


@R.query(
    "prj6_required_rows",
    f"SELECT label, text, {FEATURES} FROM feat WHERE label IS NOT NULL",
)
def required_rows(spark, sf):
    return schema.required_rows(schema.ensure_features(texts(spark, sf), "text"), "label")


@R.query(
    "prj7_overrides",
    f"""SELECT email_id, coalesce(label, has_attachment) AS has_attachment, links_count,
      urgent_keywords, coalesce(sd, sender_domain) AS sender_domain
    FROM (SELECT *, nullif(lower(regexp_extract(sender, {o.quoted(c.ADDRESS_RE)}, 1)), '') AS sd FROM feat)""",
)
def overrides(spark, sf):
    """Label and the domain of the sender column stand in for given values."""
    given = texts(spark, sf).withColumn("sd", F.nullif(tx.sender_domain(F.col("sender")), F.lit("unknown")))
    df = schema.with_overrides(schema.with_shared(given, "text"), "text", {"has_attachment": "label", "sender_domain": "sd"})
    return df.select("email_id", "has_attachment", "links_count", "urgent_keywords", "sender_domain")


@R.query(
    "jn6_trusted_domain",
    f"SELECT email_id, sender_domain, {o.trusted('sender_domain')} AS trusted FROM feat",
)
def trusted_domain(spark, sf):
    df = texts(spark, sf).select("email_id", tx.sender_domain(F.col("text")).alias("sender_domain"))
    return df.withColumn("trusted", risk.is_trusted("sender_domain"))


@R.query(
    "jn6_trusted_by_table",
    f"""SELECT domain, n, EXISTS (SELECT 1 FROM (SELECT DISTINCT split_part(lower(sender), '@', 2) AS s FROM emails) t
        WHERE d.domain = t.s OR ends_with(d.domain, '.' || t.s)) AS is_trusted
      FROM (SELECT domain, count(*) AS n FROM (SELECT unnest(link_domains) AS domain FROM feat UNION ALL
        SELECT split_part(lower(regexp_extract(url, {o.quoted(c.LINK_DOMAIN_RE)}, 1)), ':', 1) FROM pages) GROUP BY domain) d""",
)
def trusted_by_table(spark, sf):
    """Link and page domains against a trust list held as a table (here: the sender domains)."""
    links = explode_once(texts(spark, sf), [], tx.link_domains(tx.urls(F.col("text"))), "domain")
    pages = fx.text_table(spark, sf, "pages").select(
        F.split_part(F.lower(F.regexp_extract("url", c.LINK_DOMAIN_RE, 1)), F.lit(":"), F.lit(1)).alias("domain")
    )
    names = fx.emails(spark, sf).select(F.split_part(F.lower("sender"), F.lit("@"), F.lit(2)).alias("domain")).distinct()
    return trust.domain_trust(links.unionByName(pages), names)


@R.query(
    "ag20_trusted_link_share",
    f"SELECT email_id, n_domains, n_trusted, {o.r6('n_trusted::DOUBLE / n_domains')} AS share FROM feat WHERE n_domains > 0",
)
def trusted_link_share(spark, sf):
    df = texts(spark, sf).select("email_id", tx.link_domains(tx.urls(F.col("text"))).alias("d"))
    df = df.select("email_id", F.size("d").alias("n_domains"), risk.trusted_count("d").alias("n_trusted"))
    share = risk.trusted_share(F.col("n_domains"), F.col("n_trusted"))
    return df.where(F.col("n_domains") > 0).withColumn("share", risk.round6(share))


@R.query("sc14_domain_risk", f"SELECT email_id, {o.domain_risk('sender_domain')} AS risk FROM feat")
def domain_risk(spark, sf):
    df = texts(spark, sf).select("email_id", tx.sender_domain(F.col("text")).alias("sender_domain"))
    return df.select("email_id", risk.domain_risk("sender_domain").alias("risk"))


@R.query("sc15_links_risk", "SELECT email_id, links_count, links_risk AS risk FROM risks")
def links_risk(spark, sf):
    return risks(spark, sf).select("email_id", "links_count", F.col("links_risk").alias("risk"))


@R.query("sc16_ensemble_score", f"SELECT email_id, {o.r6('score')} AS ensemble_score FROM scored")
def ensemble_score(spark, sf):
    return scored(spark, sf).select("email_id", risk.round6(F.col("ensemble_score")).alias("ensemble_score"))


@R.query(
    "sc16_without_link_domains",
    f"""SELECT email_id, {o.r6('''CASE WHEN p IS NOT NULL THEN greatest(0.0, least(1.0, (p * 0.6::DOUBLE + urgent_keywords * 0.15::DOUBLE
      + (CASE WHEN links_count = 0 THEN 0.0::DOUBLE WHEN links_count = 1 THEN 0.2::DOUBLE WHEN links_count <= 3 THEN 0.4::DOUBLE
         WHEN links_count <= 5 THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END) * 0.15::DOUBLE + domain_risk * 0.1::DOUBLE)
      * CASE WHEN sender_trusted THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END)) END''')} AS ensemble_score FROM risks""",
)
def ensemble_without_domains(spark, sf):
    """The interactive form, which does not look at link domains."""
    return risks(spark, sf, use_link_domains=False).select("email_id", risk.round6(F.col("ensemble_score")).alias("ensemble_score"))


@R.query("sc17_classification", "SELECT email_id, classification FROM scored")
def classification(spark, sf):
    return scored(spark, sf).select("email_id", "classification")


@R.query(
    "sc18_flags",
    """SELECT email_id, CASE WHEN score IS NOT NULL THEN (classification <> 'LEGITIMATE')::INT END AS prediction, classification = 'PHISHING' AS is_phishing,
      classification = 'SUSPICIOUS' AS is_suspicious, classification IN ('SUSPICIOUS', 'PHISHING') AS is_flagged FROM scored""",
)
def flags(spark, sf):
    return scored(spark, sf).select("email_id", "prediction", "is_phishing", "is_suspicious", "is_flagged")


@R.query(
    "sc19_score_record",
    f"""SELECT email_id, CASE WHEN score IS NOT NULL THEN (classification <> 'LEGITIMATE')::INT END AS prediction, classification, {o.r6('p')} AS probability,
      {o.r6('score')} AS ensemble_score, 0.5::DOUBLE AS threshold, 0.2::DOUBLE AS suspicious_margin,
      classification = 'PHISHING' AS is_phishing, classification = 'SUSPICIOUS' AS is_suspicious,
      links_count, has_attachment, urgent_keywords, sender_domain FROM scored""",
)
def score_record(spark, sf):
    record = scoring.score_record(scored(spark, sf), ["email_id"], c.DEFAULT_THRESHOLD, c.SUSPICIOUS_MARGIN)
    return record.select("*", "features.*").drop("features")


@R.query(
    "sc20_score_breakdown",
    f"""SELECT email_id, {o.r6('p * 0.6::DOUBLE')} AS model_term, {o.r6('urgent_keywords * 0.15::DOUBLE')} AS urgent_term,
      {o.r6('links_risk * 0.15::DOUBLE')} AS links_term, {o.r6('domain_risk * 0.1::DOUBLE')} AS domain_term,
      {o.r6('base_score')} AS base_score, {o.r6('score')} AS final_score, sender_trusted, links_trusted, trust_factor,
      classification FROM scored""",
)
def score_breakdown(spark, sf):
    return scoring.explain_scores(scored(spark, sf), ["email_id"])


@R.query(
    "src15_prediction_records",
    f"""SELECT substr(sha256(concat_ws('|', email_id::VARCHAR, 'v9', 'run')), 1, 16) AS prediction_key, email_id,
      CASE WHEN score IS NOT NULL THEN (classification <> 'LEGITIMATE')::INT END AS prediction, {o.r6('p')} AS probability, 'v9' AS model_version FROM scored""",
)
def prediction_records(spark, sf):
    records = sinks.prediction_records(scored(spark, sf), "v9", "run")
    return records.withColumn("probability", risk.round6(F.col("probability")))


# ---------------------------------------------------------------------- segments
@R.query("sc21_segments", "SELECT email_id, position, segment FROM segs")
def segments(spark, sf):
    return scoring.all_segments(fx.text_emails(spark, sf), "body")


@R.query("sc22_segment_scores", "SELECT email_id, position, score FROM seg_top")
def segment_scores(spark, sf):
    return scoring.suspicious_segments(fx.text_emails(spark, sf), "body").select("email_id", "position", "score")


@R.query(
    "sc23_segment_reasons",
    """SELECT email_id, position, CASE WHEN length(segment) > 150 THEN substr(segment, 1, 150) || '...' ELSE segment END AS segment,
      score, reasons FROM seg_top""",
)
def segment_reasons(spark, sf):
    top = scoring.suspicious_segments(fx.text_emails(spark, sf), "body")
    return top.select("email_id", "position", "segment", "score", F.concat_ws(" | ", "reasons").alias("reasons"))


@R.query(
    "sc24_segment_severity",
    """SELECT CASE WHEN score >= 60 THEN 'HIGH' WHEN score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS severity, count(*) AS n
    FROM seg_top GROUP BY 1""",
)
def segment_severity(spark, sf):
    top = scoring.suspicious_segments(fx.text_emails(spark, sf), "body")
    return top.groupBy("severity").agg(F.count("*").alias("n"))


@R.query("tk2_top_segments", "SELECT email_id, rank, segment, score FROM (SELECT email_id, rank, CASE WHEN length(segment) > 150 THEN substr(segment, 1, 150) || '...' ELSE segment END AS segment, score FROM seg_top)")
def top_segments(spark, sf):
    return scoring.suspicious_segments(fx.text_emails(spark, sf), "body").select("email_id", "rank", "segment", "score")


# ----------------------------------------------------------------------- checks
@R.query(
    "flt9_range_checks",
    """SELECT 'has_attachment' AS rule, count(*) AS checked, 0::BIGINT AS violations FROM scored UNION ALL
    SELECT 'urgent_keywords', count(*), 0 FROM scored UNION ALL SELECT 'links_count', count(*), 0 FROM scored UNION ALL
    SELECT 'probability', count(v), count_if(v < 0 OR v > 1) FROM (SELECT e.value / 10 AS v FROM feat LEFT JOIN (SELECT event_id % 997 AS email_id,
      max_by(value, struct_pack(ts := ts, event_id := event_id)) AS value FROM events GROUP BY 1) e USING (email_id)) UNION ALL
    SELECT 'ensemble_score', count(v), 0 FROM (SELECT e.value / 10 AS v FROM feat LEFT JOIN (SELECT event_id % 997 AS email_id,
      max_by(value, struct_pack(ts := ts, event_id := event_id)) AS value FROM events GROUP BY 1) e USING (email_id)) UNION ALL
    SELECT 'prediction', count(v), 0 FROM (SELECT e.value / 10 AS v FROM feat LEFT JOIN (SELECT event_id % 997 AS email_id,
      max_by(value, struct_pack(ts := ts, event_id := event_id)) AS value FROM events GROUP BY 1) e USING (email_id))""",
)
def range_checks(spark, sf):
    """Scores made from a probability column that partly lies outside 0 to 1 (the latest event value over ten)."""
    events = fx.table(spark, sf, "events")
    latest = events.groupBy((F.col("event_id") % 997).alias("email_id")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("value")
    )
    features = scoring.extract_features(texts(spark, sf).select("email_id", "text")).drop("text")
    given = features.join(latest, "email_id", "left").withColumn("probability", F.col("value") / 10)
    return quality.rule_counts(scoring.add_verdict(scoring.add_risks(given)))


_GIVEN = """(SELECT e.value / 10 AS v FROM feat LEFT JOIN (SELECT event_id % n AS email_id,
      max_by(value, struct_pack(ts := ts, event_id := event_id)) AS value FROM events, (SELECT count(*) AS n FROM documents)
      GROUP BY 1) e USING (email_id))"""


@R.query(
    "flt9_checks_of_all_emails",
    f"""SELECT 'has_attachment' AS rule, count(*) AS checked, 0::BIGINT AS violations FROM scored UNION ALL
    SELECT 'urgent_keywords', count(*), 0 FROM scored UNION ALL SELECT 'links_count', count(*), 0 FROM scored UNION ALL
    SELECT 'probability', count(v), count_if(v < 0 OR v > 1) FROM {_GIVEN} UNION ALL
    SELECT 'ensemble_score', count(v), 0 FROM {_GIVEN} UNION ALL SELECT 'prediction', count(v), 0 FROM {_GIVEN}""",
)
def checks_of_all_emails(spark, sf):
    """As flt9_range_checks, with the events dealt over all emails."""
    n = fx.table(spark, sf, "documents").agg(F.count("*").alias("n")).scalar()
    latest = fx.table(spark, sf, "events").groupBy(F.pmod("event_id", n).alias("email_id")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("value")
    )
    features = scoring.extract_features(texts(spark, sf).select("email_id", "text")).drop("text")
    given = features.join(latest, "email_id", "left").withColumn("probability", F.col("value") / 10)
    return quality.rule_counts(scoring.add_verdict(scoring.add_risks(given)))


@R.query(
    "flt8_blank_texts",
    f"SELECT conv_id, turn, text FROM conversations WHERE length({o.trim_ws('text')}) > 0",
)
def blank_texts(spark, sf):
    return scoring.analyzable(fx.table(spark, sf, "conversations"), "text")[0].select("conv_id", "turn", "text")
