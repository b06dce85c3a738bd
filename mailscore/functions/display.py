"""Columns as a reader sees them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(p: Column, decimals: int = 2) -> Column:
    return F.when(p.isNotNull(), F.concat(F.format_string(f"%.{decimals}f", p * 100), F.lit("%")))


def badge(prediction: Column) -> Column:
    return (
        F.when(prediction.isNull(), F.lit("Not Analyzed"))
        .when(prediction == 1, F.lit("Phishing"))
        .otherwise(F.lit("Benign"))
    )


def subject_or_none(subject: Column) -> Column:
    return F.when(F.length(subject) > 0, subject).otherwise(F.lit("(No Subject)"))


def day(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit(""))
