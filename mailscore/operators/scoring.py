"""Scoring of emails: features, rule risks, ensemble score, verdict. One pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscore import constants as c
from mailscore.functions import risk, segments
from mailscore.functions import text as tx
from mailscore.operators import schema
from mailscore.operators.once import compute_once, posexplode_once

RISK_COLUMNS = ["domain_risk", "links_risk", "sender_trusted", "links_trusted", "base_score", "trust_factor"]


def extract_features(
    emails: DataFrame,
    text: str = "text",
    overrides: dict[str, str] | None = None,
    compat_serving_defaults: bool = False,
    fix_scheme_case: bool = False,
) -> DataFrame:
    """Adds the six features and ``link_domains``.

    ``compat_serving_defaults`` leaves attachment, length and exclamation marks
    at 0, as an interactive scorer without access to them would.
    """
    df = schema.with_overrides(schema.with_shared(emails, text), text, overrides or {})
    if compat_serving_defaults:
        zero = F.lit(0)
        fixed = {n: zero for n in ("body_length", "exclamation_count")}
        override = (overrides or {}).get("has_attachment")
        fixed["has_attachment"] = F.coalesce(F.col(override), zero) if override else zero
        df = df.withColumns(fixed)
    df = df.withColumn("link_domains", tx.link_domains(F.col("_urls"), fix_scheme_case)).drop("_lower", "_urls")
    return compute_once(df, [x for x in emails.columns if x not in schema.FEATURES])


def add_risks(features: DataFrame, probability: str = "probability", use_link_domains: bool = True) -> DataFrame:
    """Adds the rule risks and the ensemble score; the trust flags are worked out once."""
    known = F.size("link_domains") if use_link_domains else F.lit(0)
    trusted = risk.trusted_count("link_domains") if use_link_domains else F.lit(0)
    df = features.withColumns(
        {
            "sender_trusted": risk.is_trusted("sender_domain"),
            "trusted_share": risk.trusted_share(known, trusted),
        }
    )
    df = df.withColumns(
        {
            "links_trusted": risk.links_trusted(F.col("trusted_share")),
            "domain_risk": risk.domain_risk("sender_domain", F.col("sender_trusted")),
            "links_risk": risk.links_risk(F.col("links_count"), F.col("trusted_share")),
        }
    )
    base = risk.base_score(F.col(probability), F.col("urgent_keywords"), F.col("links_risk"), F.col("domain_risk"))
    df = df.withColumns(
        {"base_score": base, "trust_factor": risk.trust_factor(F.col("sender_trusted"), F.col("links_trusted"))}
    )
    return df.withColumn("ensemble_score", risk.clamp01(F.col("base_score") * F.col("trust_factor")))


def add_verdict(
    scored: DataFrame, threshold: float = c.DEFAULT_THRESHOLD, margin: float = c.SUSPICIOUS_MARGIN
) -> DataFrame:
    """Adds classification, prediction and the flags derived from it.

    ``is_phishing`` is the top level only; ``is_flagged`` also holds suspicious emails.
    """
    df = scored.withColumn("classification", risk.verdict(F.col("ensemble_score"), threshold, margin))
    return df.withColumns(
        {
            "prediction": risk.prediction(F.col("classification")),
            "is_phishing": F.col("classification") == c.PHISHING,
            "is_suspicious": F.col("classification") == c.SUSPICIOUS,
            "is_flagged": F.col("classification").isin(c.SUSPICIOUS, c.PHISHING),
        }
    )


def score_emails(
    emails: DataFrame,
    text: str = "text",
    probability: str = "probability",
    threshold: float = c.DEFAULT_THRESHOLD,
    margin: float = c.SUSPICIOUS_MARGIN,
    overrides: dict[str, str] | None = None,
    use_link_domains: bool = True,
    compat_serving_defaults: bool = False,
) -> DataFrame:
    """Features, risks, score and verdict of every email; without a model probability the score is null, NOT_SCORED."""
    features = extract_features(emails, text, overrides, compat_serving_defaults)
    return add_verdict(add_risks(features, probability, use_link_domains), threshold, margin)


def score_record(scored: DataFrame, keep: list[str], threshold: float, margin: float) -> DataFrame:
    """The result record: rounded scores, cut points and a nested ``features`` struct."""
    return scored.select(
        *keep,
        "prediction",
        "classification",
        risk.round6(F.col("probability")).alias("probability"),
        risk.round6(F.col("ensemble_score")).alias("ensemble_score"),
        F.lit(threshold).alias("threshold"),
        F.lit(margin).alias("suspicious_margin"),
        "is_phishing",
        "is_suspicious",
        F.struct("links_count", "has_attachment", "urgent_keywords", "sender_domain").alias("features"),
    )


def explain_scores(scored: DataFrame, keep: list[str]) -> DataFrame:
    """The score taken apart: each weighted term, base, trust flags, factor, final score."""
    terms = {
        "model_term": F.col("probability") * c.WEIGHT_MODEL,
        "urgent_term": F.col("urgent_keywords") * F.lit(c.WEIGHT_URGENT),
        "links_term": F.col("links_risk") * c.WEIGHT_LINKS,
        "domain_term": F.col("domain_risk") * c.WEIGHT_DOMAIN,
        "base_score": F.col("base_score"),
        "final_score": F.col("ensemble_score"),
    }
    return scored.select(
        *keep,
        *[risk.round6(expression).alias(name) for name, expression in terms.items()],
        "sender_trusted",
        "links_trusted",
        "trust_factor",
        "classification",
    )


def suspicious_segments(emails: DataFrame, text: str = "text", keep: tuple[str, ...] = ("email_id",)) -> DataFrame:
    """rank, text, score, reasons, severity of the top segments of each email.

    Scored, sorted and cut inside the row, so the explode yields ten rows at
    most and nothing is shuffled.
    """
    clue = segments.clues("_lower")
    prepared = emails.select(*keep, text).withColumn("_lower", F.lower(text)).withColumns({f"_{n}": x for n, x in clue.items()})
    top = segments.top_segments(segments.scored_segments(F.col(text), {n: F.col(f"_{n}") for n in clue}))
    rows = posexplode_once(prepared, list(keep), top, "_i", "s")
    return rows.select(
        *keep,
        (F.col("_i") + 1).alias("rank"),
        F.col("s.pos").alias("position"),
        F.col("s.text").alias("segment"),
        F.col("s.score").alias("score"),
        F.col("s.reasons").alias("reasons"),
        segments.severity(F.col("s.score")).alias("severity"),
    )


def all_segments(emails: DataFrame, text: str = "text", keep: tuple[str, ...] = ("email_id",)) -> DataFrame:
    """position, segment of every segment, scored or not."""
    return posexplode_once(emails, list(keep), segments.split_segments(F.col(text)), "position", "segment")


def analyzable(texts: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(usable texts, blank texts)."""
    blank = F.coalesce(F.length(tx.ws_trim(F.col(text))), F.lit(0)) == 0
    return texts.where(~blank), texts.where(blank)


def outcome_counts(requests: DataFrame, outcome: str = "outcome") -> DataFrame:
    """completed, successful, failed of a bulk run."""
    ok = F.col(outcome) == "ok"
    return requests.agg(
        F.count("*").alias("completed"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed")
    )

