"""Trust lists too long to write into an expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscore.operators.ranking import broadcast_if_small
from mailscore.session import ensure_checkpoint_dir


def dot_suffixes(domain: Column, depths: list[int]) -> Column:
    """The domain and its parent domains that have one of these numbers of labels: a.b.c at 1 and 2 → c, b.c."""
    parts = F.split(F.lower(domain), r"\.", -1)
    have = F.filter(F.lit(depths), lambda n: n <= F.size(parts))
    return F.transform(have, lambda n: F.array_join(F.slice(parts, -n, n), "."))


def domain_counts(domains: DataFrame, column: str = "domain") -> DataFrame:
    """domain, n: one row per distinct domain, however often it occurs."""
    return domains.groupBy(F.lower(column).alias("domain")).agg(F.count("*").alias("n"))


def trusted_domains(distinct_domains: DataFrame, trusted: DataFrame) -> DataFrame:
    """The distinct domains that are, or are below, a domain of the list.

    Domains are looked up from the right, only at the depths that the list
    holds, so that no suffix such as ``com`` is made unless a name of one label
    is on the list. A parent that many domains share is looked up once: the
    suffixes are made distinct first, and those found on the list, seldom more
    than a few, go to the domains and not the domains to them.
    """
    ensure_checkpoint_dir(trusted.sparkSession)
    names = trusted.where(F.col("domain").isNotNull()).select(F.lower("domain").alias("suffix")).distinct()
    size = F.size(F.split("suffix", r"\.", -1)).alias("depth")
    depths = sorted(r.depth for r in names.select(size).distinct().collect())  # numbers of labels, a handful
    if not depths:
        return distinct_domains.select("domain").limit(0)
    suffixes = distinct_domains.select("domain", F.explode(dot_suffixes(F.col("domain"), depths)).alias("suffix"))
    found = broadcast_if_small(suffixes.select("suffix").distinct().join(names, "suffix", "left_semi"))
    return suffixes.join(found, "suffix", "left_semi").select("domain").distinct()


def domain_trust(domains: DataFrame, trusted: DataFrame, column: str = "domain") -> DataFrame:
    """domain, n, is_trusted over all distinct domains."""
    ensure_checkpoint_dir(domains.sparkSession)
    counts = domain_counts(domains, column).checkpoint()  # read three times
    known = trusted_domains(counts, trusted).withColumn("_t", F.lit(True))
    return counts.join(known, "domain", "left").select(
        "domain", "n", F.coalesce("_t", F.lit(False)).alias("is_trusted")
    )
