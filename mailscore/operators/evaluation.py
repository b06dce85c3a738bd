"""Evaluation of scored rows: threshold sweep, best threshold, classification report. One pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscore import constants as c


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def _f1(hit: Column, missed: Column, wrong: Column) -> Column:
    return _ratio(hit * 2, hit * 2 + missed + wrong)


def threshold_sweep(
    scored: DataFrame, label: str = "label", probability: str = "probability", thresholds: list[float] | None = None
) -> DataFrame:
    """threshold, weighted_f1: all thresholds are counted in the same pass over the rows."""
    cuts = thresholds or c.SWEEP_THRESHOLDS
    y, p = F.col(label), F.col(probability)
    sums = [F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")]
    for i, t in enumerate(cuts):
        sums += [
            F.count_if((y == 1) & (p >= t)).alias(f"tp{i}"),
            F.count_if((y == 0) & (p >= t)).alias(f"fp{i}"),
        ]
    rows = F.array(
        *[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, t in enumerate(cuts)]
    )
    counted = scored.agg(*sums).select("pos", "neg", F.explode(rows).alias("r")).select("pos", "neg", "r.*")
    tp, fp, pos, neg = F.col("tp"), F.col("fp"), F.col("pos"), F.col("neg")
    f1_pos = _f1(tp, pos - tp, fp)
    f1_neg = _f1(neg - fp, fp, pos - tp)
    return counted.select("threshold", _ratio(f1_pos * pos + f1_neg * neg, pos + neg).alias("weighted_f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold with the highest F1; the lowest of equals, and the default where none is above 0."""
    useless = F.abs(F.col("threshold") - c.DEFAULT_THRESHOLD)
    tie = F.when(F.col("weighted_f1") > 0, F.col("threshold")).otherwise(useless)
    return sweep.orderBy(F.col("weighted_f1").desc(), tie).limit(1)


def classification_report(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """class, precision, recall, f1, support for both classes, accuracy, macro and weighted averages."""
    y, q = F.col(label), F.col(prediction)
    counts = scored.agg(
        F.count_if((y == 1) & (q == 1)).alias("tp"),
        F.count_if((y == 0) & (q == 1)).alias("fp"),
        F.count_if((y == 1) & (q == 0)).alias("fn"),
        F.count_if((y == 0) & (q == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    per_class = counts.select(
        (tn + fp).alias("s0"), _ratio(tn, tn + fn).alias("p0"), _ratio(tn, tn + fp).alias("r0"), _f1(tn, fp, fn).alias("f0"),
        (tp + fn).alias("s1"), _ratio(tp, tp + fp).alias("p1"), _ratio(tp, tp + fn).alias("r1"), _f1(tp, fn, fp).alias("f1"),
        _ratio(tp + tn, tp + tn + fp + fn).alias("acc"),
    )
    total = F.col("s0") + F.col("s1")

    def row(name: str, *values: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *[v.cast("double").alias(n) for v, n in zip(values, ("precision", "recall", "f1"))],
            values[3].alias("support"),
        )

    def macro(letter: str) -> Column:
        return (F.col(f"{letter}0") + F.col(f"{letter}1")) / 2

    def weighted(letter: str) -> Column:
        return _ratio(F.col(f"{letter}0") * F.col("s0") + F.col(f"{letter}1") * F.col("s1"), total)

    acc = F.col("acc")
    rows = F.array(
        row("0", *[F.col(n) for n in ("p0", "r0", "f0", "s0")]),
        row("1", *[F.col(n) for n in ("p1", "r1", "f1", "s1")]),
        row("accuracy", acc, acc, acc, total),
        row("macro avg", macro("p"), macro("r"), macro("f"), total),
        row("weighted avg", weighted("p"), weighted("r"), weighted("f"), total),
    )
    return per_class.select(F.explode(rows).alias("r")).select("r.*")
