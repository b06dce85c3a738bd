"""Row cleaning and checks of labels and value ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscore import constants as c
from mailscore.functions import labels


def valid_label(label: Column) -> Column:
    """True for the numbers 0 and 1; text does not count, whatever it says."""
    return F.coalesce(label.isin(0, 1), F.lit(False))


def prepare_rows(df: DataFrame, body: str = "body", label: str = "raw_label") -> DataFrame:
    """Labels as numbers, rows with label 0 or 1 and a body of more than ten characters."""
    numbered = df.withColumn("label", labels.numeric_label(F.col(label)))
    return numbered.where(F.col("label").isin(0.0, 1.0)).dropna(subset=[body, "label"]).where(
        F.length(body) > c.MIN_BODY_CHARS
    )


def label_check(df: DataFrame, label: str) -> DataFrame:
    """Valid, invalid, kept and removed rows in one pass."""
    ok = valid_label(labels.numeric_label(F.col(label)))
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("valid"),
        F.count_if(~ok).alias("invalid"),
        F.count_if(labels.numeric_label(F.col(label)).isNull()).alias("not_a_number"),
    )


def quarantine_labels(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a normalised label, rows whose label is unknown)."""
    marked = df.withColumn("label", labels.known_label(F.col(label)))
    return marked.where(F.col("label").isNotNull()), marked.where(F.col("label").isNull()).drop("label")


RULES = {
    "has_attachment": lambda x: x.isin(0, 1),
    "urgent_keywords": lambda x: x.isin(0, 1),
    "links_count": lambda x: x >= 0,
    "probability": lambda x: x.between(0, 1),
    "ensemble_score": lambda x: x.between(0, 1),
    "prediction": lambda x: x.isin(0, 1),
}


def broken_rules(df: DataFrame) -> Column:
    """Names of the value ranges a row breaks; missing values break none."""
    return F.array_compact(
        F.array(*[F.when(~rule(F.col(n)), F.lit(n)) for n, rule in RULES.items() if n in df.columns])
    )


def rule_counts(df: DataFrame) -> DataFrame:
    """rule, checked, violations over the whole table, in one pass."""
    names = [n for n in RULES if n in df.columns]
    sums = []
    for n in names:
        sums += [F.count(n).alias(f"{n}_checked"), F.count_if(~RULES[n](F.col(n))).alias(f"{n}_broken")]
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("rule"), F.col(f"{n}_checked").alias("checked"), F.col(f"{n}_broken").alias("violations")
            )
            for n in names
        ]
    )
    return df.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")
