"""The email and prediction store: keyed insert, latest verdict, pages, history, ownership."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscore import constants as c
from mailscore.functions import display
from mailscore.operators import ranking

MESSAGE_KEY = ["user_id", "message_id"]


def newest_first(ts: str = "created_at", row_id: str = "prediction_id") -> list[Column]:
    """Newest row first; rows of the same moment by id, highest first."""
    return [F.col(ts).desc(), F.col(row_id).desc()]


# ------------------------------------------------------------------------ intake
def first_arrivals(emails: DataFrame, keys: list[str] | None = None, row_id: str = "email_id") -> DataFrame:
    """One row per key, the first to arrive.

    Only keys that occur more than once travel: they are found on the narrow key
    columns and the later copies are cut from the table by an anti-join. While
    the list of such keys is small the bodies are not shuffled at all. A row that
    was delivered again, with its id, counts once; rows with a null in their key
    have no key in common with another row and all stay.
    """
    keys = keys or MESSAGE_KEY
    again = emails.where(F.col(row_id).isNotNull()).groupBy(*keys, row_id).count().where("count > 1")
    if not again.isEmpty():
        emails = emails.where(F.col(row_id).isNull()).unionByName(
            emails.where(F.col(row_id).isNotNull()).dropDuplicates([*keys, row_id])
        )
    repeated = (
        emails.groupBy(*keys)
        .agg(F.count("*").alias("_n"), F.min(row_id).alias("_first"))
        .where(F.col("_n") > 1)
        .drop("_n")
    )
    e, r = emails.alias("e"), ranking.broadcast_if_small(repeated).alias("r")
    same = [F.col(f"e.{k}") == F.col(f"r.{k}") for k in keys]
    later = F.col(f"e.{row_id}") != F.col("r._first")
    return e.join(r, [*same, later], "left_anti")


def keyed_insert(incoming: DataFrame, stored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The incoming rows to add: first per key, key not stored yet."""
    keys = keys or MESSAGE_KEY
    return missing_from(first_arrivals(incoming, keys), stored, keys)


def resolve_insert(incoming: DataFrame, stored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """For every incoming row the id of the row that holds its key: a stored one, else the first arrival."""
    keys = keys or MESSAGE_KEY
    asked = ranking.broadcast_if_small(incoming.select(*keys).distinct())
    same = reduce(and_, [F.col(f"s.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys])
    held = stored.select(*keys, "email_id").alias("s").join(asked.alias("a"), same, "left_semi")
    everything = incoming.select(*keys, "email_id", F.lit(0).alias("_old")).unionByName(
        held.select(*keys, "email_id", F.lit(1).alias("_old"))
    )
    owner = everything.groupBy(*keys).agg(
        F.coalesce(
            F.min(F.when(F.col("_old") == 1, F.col("email_id"))), F.min(F.when(F.col("_old") == 0, F.col("email_id")))
        ).alias("stored_email_id")
    )
    return ranking.join_null_safe(incoming, ranking.broadcast_if_small(owner), keys)


def missing_from(table: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys the other table does not hold; its repeated keys are made one on the map side."""
    return table.join(other.select(*keys).distinct(), keys, "left_anti")


def orphans(predictions: DataFrame, emails: DataFrame) -> DataFrame:
    """Predictions whose email is gone. Ids of emails are unique, so the join can split an email with many predictions."""
    return predictions.join(emails.select("email_id"), "email_id", "left_anti")


# ------------------------------------------------------------------------ latest
def latest_predictions(predictions: DataFrame) -> DataFrame:
    """The newest prediction of every email; an email with very many costs one row per task."""
    fields = [x for x in predictions.columns if x != "email_id"]
    newest = F.max(F.struct("created_at", "prediction_id", *[x for x in fields if x not in ("created_at", "prediction_id")]))
    return (
        predictions.groupBy("email_id")
        .agg(newest.alias("latest"))
        .select("email_id", *[F.col(f"latest.{x}").alias(x) for x in fields])
    )


def with_latest_prediction(emails: DataFrame, predictions: DataFrame) -> DataFrame:
    """Emails with their newest prediction, nulls where there is none."""
    return emails.join(latest_predictions(predictions), "email_id", "left")


# ----------------------------------------------------------------- pages, history
def email_page(emails: DataFrame, user_id: int, limit: int = c.EMAIL_PAGE[0], offset: int = 0) -> DataFrame:
    """A page of one user's emails, newest first."""
    own = emails.where(F.col("user_id") == user_id)
    return ranking.page(own, newest_first("received_at", "email_id"), limit, offset, c.EMAIL_PAGE[1])


def email_pages(emails: DataFrame, limit: int = c.EMAIL_PAGE[0], offset: int = 0) -> DataFrame:
    """The same page for every user."""
    order = newest_first("received_at", "email_id")
    return ranking.group_pages(emails, ["user_id"], order, limit, offset, c.EMAIL_PAGE[1])


def user_predictions(predictions: DataFrame, emails: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Predictions with the user (and further columns) of their email."""
    return predictions.join(emails.select("email_id", "user_id", *(columns or [])), "email_id")


def prediction_page(
    predictions: DataFrame, emails: DataFrame, user_id: int, limit: int = c.HISTORY_PAGE[0], offset: int = 0
) -> DataFrame:
    """A page of the predictions on one user's emails, newest first."""
    own = user_predictions(predictions, emails.where(F.col("user_id") == user_id))
    return ranking.page(own, newest_first(), limit, offset, c.HISTORY_PAGE[1])


def prediction_pages(
    predictions: DataFrame, emails: DataFrame, limit: int = c.HISTORY_PAGE[0], offset: int = 0
) -> DataFrame:
    """The same page of predictions for every user."""
    own = user_predictions(predictions, emails)
    return ranking.group_pages(own, ["user_id"], newest_first(), limit, offset, c.HISTORY_PAGE[1])


def prediction_history(predictions: DataFrame) -> DataFrame:
    """All predictions with their place in the email's history, newest = 1; no task holds a long history whole."""
    return ranking.whole_row_number(predictions, ["email_id"], newest_first(), "history_rank")


def history_with_email(predictions: DataFrame, emails: DataFrame, columns: list[str]) -> DataFrame:
    """Predictions with the details of their email, nulls where the email is gone."""
    return predictions.join(emails.select("email_id", *columns), "email_id", "left")


# --------------------------------------------------------------------- selection
def of_user(emails: DataFrame, user_id: int | Column) -> DataFrame:
    """The rows of one user."""
    return emails.where(F.col("user_id") == user_id)


def lookup(table: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with the wanted keys: one id, one (user, message id), or a whole table of them.

    Keys asked for again and again are made one on the map side.
    """
    return table.join(wanted.select(*keys).distinct(), keys, "left_semi")


def select_emails(emails: DataFrame, selected: DataFrame) -> DataFrame:
    """Emails whose id is in the selection."""
    return lookup(emails, selected, ["email_id"])


def split_owned(requests: DataFrame, emails: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(granted, denied) requests: the email must exist and belong to the user who asks."""
    owned = emails.select("email_id", "user_id")
    on = ["email_id", "user_id"]
    return requests.join(owned, on, "left_semi"), requests.join(owned, on, "left_anti")


def request_outcome(requests: DataFrame, emails: DataFrame) -> DataFrame:
    """Adds outcome: ``ok``, ``not found`` or ``access denied``."""
    owner = emails.select("email_id", F.col("user_id").alias("_owner"))
    outcome = (
        F.when(F.col("_owner").isNull(), F.lit("not found"))
        .when(F.col("_owner") != F.col("user_id"), F.lit("access denied"))
        .otherwise(F.lit("ok"))
    )
    return requests.join(owner, "email_id", "left").withColumn("outcome", outcome).drop("_owner")


def emails_per_user(emails: DataFrame) -> DataFrame:
    return emails.groupBy("user_id").agg(F.count("*").alias("n_emails"))


# ----------------------------------------------------------------------- reports
def email_report(emails: DataFrame, predictions: DataFrame) -> DataFrame:
    """The list of emails as shown: subject, sender, day, badge and confidence."""
    return with_latest_prediction(emails, predictions.select("email_id", "prediction_id", "prediction", "probability", "created_at")).select(
        "email_id",
        display.subject_or_none(F.col("subject")).alias("subject"),
        F.coalesce("sender", F.lit("")).alias("sender"),
        display.day(F.col("received_at")).alias("day"),
        display.badge(F.col("prediction")).alias("badge"),
        F.coalesce(display.percent(F.col("probability")), F.lit("")).alias("confidence"),
    )


def history_report(predictions: DataFrame, emails: DataFrame) -> DataFrame:
    """The list of predictions as shown; ``N/A`` where the email is gone."""
    known = emails.select("email_id", "subject", "sender", F.lit(True).alias("_known"))
    gone = F.col("_known").isNull()
    return predictions.join(known, "email_id", "left").select(
        "prediction_id",
        F.when(gone, F.lit("N/A")).otherwise(display.subject_or_none(F.col("subject"))).alias("subject"),
        F.when(gone, F.lit("N/A")).otherwise(F.coalesce("sender", F.lit(""))).alias("sender"),
        display.badge(F.col("prediction")).alias("badge"),
        display.percent(F.col("probability")).alias("confidence"),
        display.day(F.col("created_at")).alias("day"),
    )
