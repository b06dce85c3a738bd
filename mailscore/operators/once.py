"""Keeping costly columns from being worked out twice.

Spark also tests an array for being empty before it explodes it, and moves that
test below the projection that makes the array. Arrays that are dear to make
are therefore exploded with the outer form, which has no such test, and the null
row of an empty array is cut afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The same rows, with columns that a later filter cannot pull apart.

    Spark moves a filter below the projection that makes its column and so
    works out the column's expression a second time, which is dear where that
    is a scan of the whole text. A filter stays above a generator, here one
    that yields exactly one row per row. ``keep`` names cheap columns that
    filters may still pass.
    """
    keep = keep or []
    made = [F.col(f"`{x}`") for x in df.columns if x not in keep]
    return df.select(*keep, F.inline(F.array(F.struct(*made)))).select(*df.columns)


def explode_once(df: DataFrame, keep: list[str], array: Column, name: str) -> DataFrame:
    """The kept columns and one row per element of an array that is dear to make; elements are never null."""
    rows = df.select(*keep, F.explode_outer(array).alias(name))
    return rows.where(F.col(name).isNotNull())


def posexplode_once(df: DataFrame, keep: list[str], array: Column, position: str, name: str) -> DataFrame:
    """As :func:`explode_once`, with the position of the element, from 0."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, name))
    return rows.where(F.col(position).isNotNull())
