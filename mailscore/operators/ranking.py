"""Ranks and pages that hold when one group has most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mailscore.session import ensure_checkpoint_dir

# Up to this many rows per group Spark cuts each group before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000

# Groups of up to this many rows are sorted in one task.
LONG_GROUP = 1_000_000

# Narrow tables of up to this many rows may go to every executor.
BROADCAST_ROWS = 500_000


def ranged_slices(df: DataFrame, keys: list[str], order: list[Column], rows: int) -> DataFrame:
    """Adds _slice: stretches of groups in order, of about ``rows`` rows each, cut where a sample of the data says.

    The rows are dealt by ranges of group and order, so a group of any size is
    spread over as many tasks as it needs. They are written out, because a
    second run would draw another sample.
    """
    ensure_checkpoint_dir(df.sparkSession)
    parts = max(1, -(-2 * df.count() // rows))
    dealt = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    return dealt.withColumn("_slice", F.spark_partition_id()).checkpoint()


def whole_row_number(
    df: DataFrame, keys: list[str], order: list[Column], name: str, rows: int = LONG_GROUP
) -> DataFrame:
    """row_number per group, whatever the size of a group; ``order`` must leave no ties.

    Groups are counted first. Those of more than ``rows`` rows are numbered
    stretch by stretch (:func:`ranged_slices`); the counts of earlier stretches,
    one small row each, are summed up and added. The others take one shuffle.
    """
    ensure_checkpoint_dir(df.sparkSession)
    long = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > rows).select(*keys).checkpoint()
    short = F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint")
    found = long.count()
    if not found:
        return df.withColumn(name, short)
    renamed = long.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    known = F.broadcast(renamed) if found <= BROADCAST_ROWS else renamed
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    sliced = ranged_slices(df.join(known, same, "left_semi"), keys, order, rows)
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    local = sliced.withColumn("_local", F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order)))
    numbered = join_null_safe(local, offsets, [*keys, "_slice"])
    numbered = numbered.withColumn(name, F.col("_local") + F.col("_before")).drop("_slice", "_local", "_before")
    return df.join(known, same, "left_anti").withColumn(name, short).unionByName(numbered)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join in which null keys meet too, so that no row is lost."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, same).drop(*[f"_right_{k}" for k in keys])


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table written out and counted; marked for broadcast only if it is small.

    Without this a join with a table of unknown size starts to shuffle its other
    side before the size is known.
    """
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint()
    return F.broadcast(kept) if kept.count() <= rows else kept


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "position") -> DataFrame:
    """The first ``k`` rows of every group; up to the limit above each task sends on at most ``k`` rows of a group."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= k)


def group_pages(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    limit: int,
    offset: int = 0,
    most: int | None = None,
    name: str = "position",
) -> DataFrame:
    """Rows offset + 1 to offset + limit of every group, newest first.

    Beyond the limit above all rows are numbered, long groups stretch by stretch, so that no task holds a whole one.
    """
    if not 1 <= limit <= (most or limit) or offset < 0:
        raise ValueError(f"limit must be 1 to {most}, offset 0 or more")
    if offset + limit > GROUP_LIMIT:
        ranked = whole_row_number(df, keys, order, name)
        return ranked.where((F.col(name) > offset) & (F.col(name) <= offset + limit))
    return first_per_group(df, keys, order, offset + limit, name).where(F.col(name) > offset)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int | None = None) -> DataFrame:
    """One page of a sorted table."""
    if not 1 <= limit <= (most or limit) or offset < 0:
        raise ValueError(f"limit must be 1 to {most}, offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def share_of_total(counts: DataFrame, n: str = "n") -> Column:
    """Each count as a share of all: the total is a scalar sub-query, so no task holds all groups."""
    return F.col(n) / counts.agg(F.sum(n).alias("total")).scalar()
