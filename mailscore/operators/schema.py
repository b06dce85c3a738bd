"""Column names, text and label resolution, feature columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailscore import constants as c
from mailscore.functions import text as tx

_LABEL_TYPES = (T.NumericType, T.BooleanType)
FEATURES = [*c.FEATURE_NUMERIC, "sender_domain"]


def normalize_columns(df: DataFrame) -> DataFrame:
    """Column names trimmed and in lower case."""
    return df.toDF(*[name.strip().lower() for name in df.columns])


def text_expression(df: DataFrame, preferred: str | None = None) -> Column:
    """Preferred column, else subject with email_text, else either of them."""
    names = df.columns
    if preferred and preferred.lower() in names:
        return F.col(preferred.lower())
    if "subject" in names and "email_text" in names:
        neither = F.col("subject").isNull() & F.col("email_text").isNull()
        return F.when(~neither, F.concat_ws(" ", "subject", "email_text"))
    for name in ("email_text", "subject"):
        if name in names:
            return F.col(name)
    raise KeyError(f"no usable text column among {names}")


def label_column(df: DataFrame, preferred: str | None = None) -> str:
    """Preferred column, else the first usual label name."""
    names = df.columns
    for name in [(preferred or "").lower(), *c.TRAINING_LABEL_COLUMNS]:
        if name in names:
            return name
    raise KeyError(f"no label column among {names}")


def profile(df: DataFrame) -> DataFrame:
    """column, filled, distinct_values, mean_chars of every column, in one scan.

    Values become (column, value or its digest) pairs that are counted on the
    map side, so a value that fills a third of the rows is no burden, and long
    texts do not travel.
    """
    pairs = [
        F.struct(F.lit(name).alias("column"), F.col(f"`{name}`").cast("string").alias("value")) for name in df.columns
    ]
    cells = df.select(F.explode(F.array(*pairs)).alias("cell")).select("cell.*").where(F.col("value").isNotNull())
    brief = F.when(F.length("value") > 64, F.sha2("value", 256)).otherwise(F.col("value"))
    counted = (
        cells.select("column", brief.alias("brief"), F.length("value").alias("chars"))
        .groupBy("column", "brief")
        .agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    )
    return counted.groupBy("column").agg(
        F.sum("n").alias("filled"),
        F.count("*").alias("distinct_values"),
        (F.sum("chars") / F.sum("n")).alias("mean_chars"),
    )


def auto_detect(df: DataFrame, text: str | None = None, label: str | None = None) -> tuple[str, str]:
    """(text column, label column): given names, usual names, else by the data.

    By the data: the string column with the longest mean length is the text;
    the first numeric or boolean column (else the first one) with at most ten
    distinct values is the label.
    """

    def usual(candidates: list[str]) -> str | None:
        return next((name for name in candidates if name in df.columns), None)

    text = (text or "").strip().lower() or usual(c.TEXT_COLUMNS)
    label = (label or "").strip().lower() or usual(c.LABEL_COLUMNS)
    if text and label:
        return text, label
    facts = {r["column"]: r for r in profile(df).collect()}  # one row per column
    if not text:
        strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        if not strings:
            raise ValueError("no string column to use as the text")
        text = max(strings, key=lambda n: facts[n].mean_chars if n in facts else 0.0)
    if not label:
        few = [f for f in df.schema if f.name not in facts or facts[f.name].distinct_values <= 10]
        if not few:
            raise ValueError("no column with few values to use as the label")
        label = next((f.name for f in few if isinstance(f.dataType, _LABEL_TYPES)), few[0].name)
    return text, label


def with_shared(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_lower`` and ``_urls``, which several features read, so that each is worked out once."""
    return df.withColumn("_lower", F.lower(text)).withColumn("_urls", tx.urls(F.col(text), F.col("_lower")))


def feature_expressions(text: Column) -> dict[str, Column]:
    """The six features of a text, on rows that :func:`with_shared` has prepared."""
    return {
        "has_attachment": tx.attachment_flag("_lower"),
        "links_count": tx.url_count(F.col("_urls")),
        "urgent_keywords": tx.urgent_flag("_lower"),
        "sender_domain": tx.sender_domain(text),
        "body_length": tx.char_count(text),
        "exclamation_count": tx.exclamation_count(text),
    }


def ensure_features(df: DataFrame, text: str = "body") -> DataFrame:
    """Adds each feature column that is missing; null features become 0 or ``unknown``."""
    made = {n: expression for n, expression in feature_expressions(F.col(text)).items() if n not in df.columns}
    df = with_shared(df, text).withColumns(made) if made else df
    settled = {n: F.coalesce(F.col(n).try_cast("int"), F.lit(0)) for n in c.FEATURE_NUMERIC}
    settled["sender_domain"] = F.coalesce(F.col("sender_domain").cast("string"), F.lit("unknown"))
    return df.withColumns(settled).drop("_lower", "_urls")


def with_overrides(prepared: DataFrame, text: str, overrides: dict[str, str]) -> DataFrame:
    """Features of the text, but a filled override column (feature → column) wins over extraction."""
    features = {
        name: F.coalesce(F.col(overrides[name]), expression) if name in overrides else expression
        for name, expression in feature_expressions(F.col(text)).items()
    }
    return prepared.withColumns(features)


def required_rows(df: DataFrame, label: str, columns: list[str] | None = None) -> DataFrame:
    """Label and features only, rows with any null dropped.

    Only columns that can be null are tested, as a test is pushed below the
    projection and would work out the whole expression of a feature again.
    """
    rows = df.select(label, *(columns or c.FEATURE_COLUMNS))
    for f in rows.schema:
        if f.nullable:
            rows = rows.where(F.col(f.name).isNotNull())
    return rows
