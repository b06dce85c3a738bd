"""Scoring of a whole table with a trained model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscore.functions import text as tx
from mailscore.operators import scoring, store
from mailscore.plans.train import TrainedModel
from mailscore.sources import sinks


def with_model_probability(emails: DataFrame, model: TrainedModel, text: str = "text") -> DataFrame:
    """Adds the features and the model's probability; works on batch and streaming tables."""
    features = scoring.extract_features(emails.withColumn("_raw", F.col(text)), "_raw")
    rows = features.withColumn("text", tx.normalize_text(F.col("_raw")))
    out = model.probability(rows)
    return out.drop("_raw")


def score_table(emails: DataFrame, model: TrainedModel, text: str = "text", use_link_domains: bool = True) -> DataFrame:
    """Features, probability, risks, score and verdict of every email."""
    scored = scoring.add_risks(with_model_probability(emails, model, text), "probability", use_link_domains)
    return scoring.add_verdict(scored, model.threshold, model.margin)


def analyze_requests(
    requests: DataFrame, emails: DataFrame, model: TrainedModel, text: str = "body", run: str = ""
) -> tuple[DataFrame, DataFrame]:
    """(prediction records, requests with their outcome) of a bulk run.

    A request names an email and the user who asks. An email that is asked for
    many times is scored once; every granted request gets its own record. The
    requests themselves are joined with narrow rows only, in joins of their own,
    so that a much-requested email can be split over tasks.
    """
    owned = ["email_id", "user_id"]
    wanted = store.lookup(emails.select(*owned, text), requests, owned)
    scored = score_table(wanted, model, text).select(*owned, "prediction", "probability")
    records = sinks.prediction_records(requests.join(scored, owned), model.version, run, "request_id")
    return records, store.request_outcome(requests, emails)
