"""Corpus reports: label and length distributions, dashboard figures, samples.

Lengths are first counted per distinct value. Quartiles and medians are then
exact percentiles over that small histogram, weighted by its counts, so the
one task that finishes them sees distinct lengths, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscore import constants as c
from mailscore.functions import labels
from mailscore.operators import ranking


# ------------------------------------------------------------------------ labels
def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def label_percentages(df: DataFrame, label: str = "label") -> DataFrame:
    """Share of each label among the labelled rows, with its display name."""
    counts = label_counts(df.where(F.col(label).isNotNull()), label)
    return counts.select(
        label,
        labels.label_name(F.col(label)).alias("label_name"),
        "n",
        (ranking.share_of_total(counts) * 100).alias("percentage"),
    )


def top_labels(df: DataFrame, label: str, k: int = 20) -> DataFrame:
    """The most frequent label values, valid or not."""
    counts = label_counts(df.where(F.col(label).isNotNull()), label)
    return counts.orderBy(F.col("n").desc(), F.col(label)).limit(k)


# ----------------------------------------------------------------------- lengths
def length_counts(df: DataFrame, text: str = "body", by: tuple[str, ...] = ()) -> DataFrame:
    """chars, n (and the group columns): how many texts have which length."""
    return df.select(*by, F.length(text).alias("chars")).groupBy(*by, "chars").agg(F.count("*").alias("n"))


def _sum_exact(x: Column) -> Column:
    return F.sum(x.cast("decimal(38,0)")).cast("decimal(38,0)")


def length_description(counts: DataFrame) -> DataFrame:
    """count, mean, std (of a sample), min, quartiles, max of the lengths."""
    filled = counts.where(F.col("chars").isNotNull())
    big = F.col("chars").cast("decimal(20,0)")
    sums = filled.agg(
        F.sum("n").alias("count"),
        _sum_exact(big * F.col("n")).alias("_s"),
        _sum_exact(big * big * F.col("n")).alias("_q"),
        F.min("chars").alias("min"),
        F.percentile("chars", [0.25, 0.5, 0.75], F.col("n")).alias("_p"),
        F.max("chars").alias("max"),
    )
    n = F.col("count")
    spread = F.col("_q") * n - F.col("_s") * F.col("_s")
    return sums.select(
        "count",
        (F.col("_s").cast("double") / n).alias("mean"),
        F.sqrt(spread.cast("double") / F.nullif(n.cast("double") * (n - 1), F.lit(0.0))).alias("std"),
        "min",
        F.col("_p")[0].alias("q25"),
        F.col("_p")[1].alias("median"),
        F.col("_p")[2].alias("q75"),
        "max",
    )


def length_by_label(counts: DataFrame, label: str = "label") -> DataFrame:
    """count, mean, median, min, max of the lengths per label."""
    return (
        counts.where(F.col(label).isNotNull())
        .groupBy(label)
        .agg(
            F.sum("n").alias("count"),
            (F.sum(F.col("chars") * F.col("n")) / F.sum("n")).alias("mean"),
            F.percentile("chars", F.lit(0.5), F.col("n")).alias("median"),
            F.min("chars").alias("min"),
            F.max("chars").alias("max"),
        )
    )


def length_median(counts: DataFrame) -> DataFrame:
    return counts.agg(F.percentile("chars", F.lit(0.5), F.col("n")).alias("median"))


def length_bucket(chars: Column) -> Column:
    """Name of the length bucket; an empty text is in none."""
    bucket = F.when(chars <= 0, F.lit(None).cast("string"))
    for name, upper in c.LENGTH_BUCKETS[:-1]:
        bucket = bucket.when(chars <= upper, F.lit(name))
    return bucket.when(chars.isNotNull(), F.lit(c.LENGTH_BUCKETS[-1][0]))


def length_histogram(counts: DataFrame) -> DataFrame:
    """bucket, n of the buckets that occur."""
    bucketed = counts.select(length_bucket(F.col("chars")).alias("bucket"), "n")
    return bucketed.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("n").alias("n"))


def length_crosstab(counts: DataFrame, label: str = "label") -> DataFrame:
    """bucket × label with margins (``All``); the cube runs on the histogram, not on the rows."""
    bucketed = counts.select(length_bucket(F.col("chars")).alias("bucket"), F.col(label).cast("string").alias("lab"), "n")
    cubed = bucketed.dropna(subset=["bucket", "lab"]).cube("bucket", "lab").agg(F.sum("n").alias("n"))
    return cubed.select(
        F.coalesce("bucket", F.lit("All")).alias("bucket"), F.coalesce("lab", F.lit("All")).alias("label"), "n"
    )


def phishing_rate_by_length(counts: DataFrame, label: str = "label") -> DataFrame:
    """bucket, n, phishing_rate (per cent); a row without label counts as not phishing."""
    hits = F.when(F.col(label) == 1, F.col("n")).otherwise(0)
    bucketed = counts.withColumn("bucket", length_bucket(F.col("chars"))).where(F.col("bucket").isNotNull())
    return bucketed.groupBy("bucket").agg(
        F.sum("n").alias("n"), (F.sum(hits) / F.sum("n") * 100).alias("phishing_rate")
    )


def extreme_lengths(df: DataFrame, text: str = "body", label: str = "label", above: int = c.EXTREME_LENGTH) -> DataFrame:
    """Number, labels and phishing rate of the very long texts."""
    long = df.where(F.length(text) > above)
    return long.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(label) == 1).alias("phishing"),
        F.count_if(F.col(label) == 0).alias("legitimate"),
        (F.avg(F.coalesce((F.col(label) == 1).cast("int"), F.lit(0))) * 100).alias("phishing_rate"),
    )


# --------------------------------------------------------------------- dashboard
def dashboard(emails: DataFrame, prediction: str = "prediction", probability: str = "probability") -> DataFrame:
    """Key figures over emails with their latest prediction (null = not analysed)."""
    p, x = F.col(prediction), F.col(probability)
    sums = emails.agg(
        F.count("*").alias("total"),
        F.count(p).alias("analyzed"),
        F.count_if(p == 1).alias("phishing"),
        F.count_if(p == 0).alias("benign"),
        F.coalesce(F.avg(F.when(p.isNotNull(), x)), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.min(F.when(p.isNotNull(), x)), F.lit(0.0)).alias("min_confidence"),
        F.coalesce(F.max(F.when(p.isNotNull(), x)), F.lit(0.0)).alias("max_confidence"),
    )
    analyzed = F.nullif(F.col("analyzed"), F.lit(0))

    def share(name: str) -> Column:
        return F.coalesce(F.col(name) / analyzed * 100, F.lit(0.0)).alias(f"{name}_percentage")

    return sums.select(
        "*", (F.col("total") - F.col("analyzed")).alias("not_analyzed"), share("phishing"), share("benign")
    )


# ----------------------------------------------------------------------- samples
def label_samples(df: DataFrame, sizes: dict[int, int], shown: int = 500) -> DataFrame:
    """The first bodies of each label, cut to ``shown`` characters."""
    first = ranking.first_per_group(df.where(F.col("label").isin(*sizes)), ["label"], [F.col("email_id")], max(sizes.values()))
    wanted = F.lit(False)
    for label, k in sizes.items():
        wanted = wanted | ((F.col("label") == label) & (F.col("position") <= k))
    cut = F.concat(F.substring("body", 1, shown), F.lit("..."))
    return first.where(wanted).select(
        "label", "position", "email_id", F.when(F.length("body") > shown, cut).otherwise(F.col("body")).alias("sample")
    )


def run_summary(history: DataFrame, dataset: str, label: str) -> DataFrame:
    """One row: number of data sets and samples, distribution of the two valid labels as a map.

    A label that does not occur has no entry; rows with another label or none count as samples only.
    """
    per = history.groupBy(dataset).agg(
        F.count("*").alias("n"), *[F.count_if(F.col(label).cast("string") == str(k)).alias(f"_{k}") for k in (0, 1)]
    )
    found = per.agg(
        F.count(dataset).alias("num_datasets"), F.sum("n").alias("num_samples"), *[F.sum(f"_{k}").alias(f"_{k}") for k in (0, 1)]
    )
    counts = F.create_map(*[x for k in (0, 1) for x in (F.lit(str(k)), F.coalesce(f"_{k}", F.lit(0)))])
    return found.select("num_datasets", "num_samples", F.map_filter(counts, lambda _, n: n > 0).alias("label_distribution"))
