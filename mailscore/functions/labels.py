"""Label normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailscore import constants as c
from mailscore.functions.text import ws_trim


def known_label(value: Column) -> Column:
    """1 for a phishing word, 0 for a legitimate one, null for anything else."""
    v = F.lower(ws_trim(value.cast("string")))
    return F.when(v.isin(c.PHISHING_LABELS), F.lit(1)).when(v.isin(c.LEGITIMATE_LABELS), F.lit(0))


def strict_label(value: Column) -> Column:
    """As :func:`known_label`, but an unknown or missing label fails the job."""
    complaint = F.concat(F.lit("unknown label: "), F.coalesce(value.cast("string"), F.lit("(missing)")))
    return F.coalesce(known_label(value), F.raise_error(complaint).cast("int"))


def lenient_label(value: Column) -> Column:
    """Known word, else number, else 0; a number is 1 if its whole part is not 0 (0.5 is 0)."""
    v = F.lower(ws_trim(value.cast("string")))
    number = (
        F.when(v.isin(c.LENIENT_PHISHING_LABELS), F.lit(1.0))
        .when(v.isin(c.LENIENT_LEGITIMATE_LABELS), F.lit(0.0))
        .otherwise(numeric_label(v))
    )
    whole = F.when(F.isnan(number), F.lit(0.0)).otherwise(F.coalesce(number, F.lit(0.0)))
    return (F.abs(whole) >= 1).cast("int")


def numeric_label(value: Column) -> Column:
    """The label as a number; text that is none becomes null."""
    v = value.cast("string")
    # Java also reads 1d and 1f as numbers
    return F.when(~F.rlike(v, F.lit(r"[0-9.][dDfF]\s*$")), v).try_cast("double")


def label_name(label: Column) -> Column:
    return F.when(label == 0, F.lit("Legitimate (0)")).otherwise(F.lit("Phishing (1)"))
