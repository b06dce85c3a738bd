"""Sinks for cleaned sets, run metadata and scored emails."""

from __future__ import annotations

import os
import zlib
from itertools import groupby
from urllib.parse import quote, unquote, urlparse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW_FOLDERS = 256  # folders that raw messages are dealt to; a reader lists them in parallel


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """Comma-separated files with a header; quotes inside a field are doubled."""
    (
        df.write.mode("overwrite")
        .option("header", "true")
        .option("quoteAll", str(quote_all).lower())
        .option("escape", '"')
        .csv(path)
    )


def write_metadata(summary: DataFrame, path: str) -> None:
    """The one-row run summary as one JSON line."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """A table cut by the hash of a key: joins and groups on the key need no shuffle.

    Emails and predictions that are joined again and again are kept so, by
    email_id and with the same number of buckets. Rows come together by key
    before the write, so every bucket is one file.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def prediction_key(*parts: str | Column) -> Column:
    """A key that a repeated run computes again, so that appended records can be told apart."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def prediction_records(scored: DataFrame, model_version: str, run: str = "", row_id: str = "email_id") -> DataFrame:
    """prediction_key, email_id, prediction, probability, model_version of scored emails (or requests)."""
    version = F.coalesce(F.lit(model_version), F.lit("unknown"))
    return scored.select(
        prediction_key(F.col(row_id).cast("string"), version, F.lit(run)).alias("prediction_key"),
        "email_id",
        "prediction",
        "probability",
        version.alias("model_version"),
    )


def append_predictions(records: DataFrame, path: str) -> None:
    """Append records stamped with the time of writing."""
    records.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_raw_messages(df: DataFrame, folder: str, key: str, text: str) -> None:
    """One raw file for each key, named ``<key>=<value>``, in folders of a bounded number; a line for each of its rows.

    Spark's own writer opens a folder and, on a disk that machines share, starts two programs to set the rights of every
    file, and a reader lists every folder apart. So on such a disk the tasks write the files themselves; a task that is
    run again replaces them. Other stores are written by Spark.
    """
    spark = df.sparkSession
    place = f"{folder}-place"
    spark.range(1).selectExpr("'' AS value").write.text(place)
    whole = urlparse(spark.read.text(place).inputFiles()[0])  # with the scheme that paths without one have here
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("binary").alias("text")).repartition("key")
    if whole.scheme != "file":
        rows.select(F.col("key").alias(key), F.col("text").cast("string")).write.partitionBy(key).text(folder)
        return
    root = unquote(whole.path).rpartition("/")[0].removesuffix("-place")
    folders = RAW_FOLDERS

    def write(part) -> None:
        for value, lines in groupby(part, lambda r: r.key):
            name = "__HIVE_DEFAULT_PARTITION__" if value is None else quote(value, safe="")
            at = f"{root}/{zlib.crc32(name.encode()) % folders}"
            os.makedirs(at, exist_ok=True)
            with open(f"{at}/{key}={name}", "wb") as file:
                for line in lines:
                    file.write((line.text or b"") + b"\n")

    os.makedirs(root, exist_ok=True)
    open(f"{root}/_SUCCESS", "wb").close()  # so that a folder of no messages can be read as well
    rows.sortWithinPartitions("key").foreachPartition(write)
