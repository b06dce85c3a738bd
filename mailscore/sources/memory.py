"""Dataset memory: every data set ever seen, stored once by content fingerprint."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mailscore import constants as c
from mailscore.operators import ranking
from mailscore.session import ensure_checkpoint_dir
from mailscore.sources import records

MANY_SPLITS = 200_000  # rows of a broadcast; beyond it the lines are joined by a shuffle
_CHUNKS, _CHUNK_HEX = 4, 15


def row_fingerprint(*columns: str | Column) -> Column:
    """First 16 hex digits of SHA-256 over the columns of a row."""
    return F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, c.FINGERPRINT_CHARS)


def multiset_digest(sha: Column) -> Column:
    """Aggregate: fingerprint of a set of rows, whatever their order.

    Sums of the four 60-bit parts of each row's SHA-256 plus the row count;
    the sums combine on the map side, so a data set of any size needs one row
    per task in the shuffle.
    """
    sums = [
        F.sum(
            F.conv(F.substring(sha, 1 + i * _CHUNK_HEX, _CHUNK_HEX), 16, 10).cast("decimal(20,0)")
        ).cast("decimal(38,0)").cast("string")
        for i in range(_CHUNKS)
    ]
    whole = F.concat_ws("|", F.count(sha).cast("string"), *sums)
    return F.substring(F.sha2(whole, 256), 1, c.FINGERPRINT_CHARS)


def file_fingerprints(spark: SparkSession, paths: list[str], head_bytes: int | None = None) -> DataFrame:
    """path, fingerprint of text files: a digest of their numbered lines, whatever the size and the splits of a file.

    A line's number is its place in its split plus the lines of the splits before; so files with the same lines in
    another order differ, and, as carriage returns and the file's size count, files with other line ends. Spark's file sources leave out empty files, which so have none. With ``head_bytes`` only the beginning counts: SHA-256 of so many bytes.
    """
    if head_bytes is not None:
        head = F.sha2(F.substring("content", 1, head_bytes), 256)
        files = spark.read.format("binaryFile").load(paths)
        return files.select("path", F.substring(head, 1, c.FINGERPRINT_CHARS).alias("fingerprint"))
    split = ["path", "block"]
    # split at line feeds alone, so that a carriage return is part of its line
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("bytes"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )
    split = ["path", "block"]
    sizes = lines.groupBy(*split).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*split, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    numbered = lines.join(F.broadcast(starts) if starts.count() <= MANY_SPLITS else starts, split)
    sha = F.sha2(F.concat_ws("|", F.col("id") + F.col("shift"), "bytes", "value"), 256)
    return numbered.groupBy("path").agg(multiset_digest(sha).alias("fingerprint"))


def unseen(incoming: DataFrame, manifest: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Incoming rows whose key the manifest does not hold, one per key."""
    return incoming.dropDuplicates([key]).join(manifest.select(key), key, "left_anti")


def with_status(
    incoming: DataFrame, manifest: DataFrame, key: str = "fingerprint", name: str = "dataset"
) -> DataFrame:
    """Adds status: ``[CACHE]`` for the first data set, by name, of a key that the manifest does not hold, else ``[SKIP]``."""
    known = manifest.select(key).distinct().withColumn("_known", F.lit(True))
    first = incoming.groupBy(key).agg(F.min(name).alias("_first"))
    marked = incoming.join(first, key).join(known, key, "left")
    skip = F.coalesce("_known", F.lit(False)) | (F.col(name) != F.col("_first"))
    return marked.withColumn("status", F.when(skip, "[SKIP]").otherwise("[CACHE]")).drop("_known", "_first")


class DatasetMemory:
    """History folder: ``rows/rejected=…/dataset_hash=…`` in Parquet, plus a manifest of one line per data set.

    Rows that could not be read are kept under ``rejected=true``, with what they were in the column ``_bad_row``.
    """

    MANIFEST = "fingerprint string, source string, columns string, n_rows bigint, n_rejected bigint"

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.data = f"{root}/rows"
        self.manifest_path = f"{root}/manifest"

    def _stored(self, schema: str, path: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        """fingerprint, source, columns (a JSON list), n_rows, n_rejected of every cached data set."""
        return self._stored(self.MANIFEST, self.manifest_path).dropDuplicates(["fingerprint"])

    def cache(self, paths: list[str]) -> dict[str, str]:
        """Store the files whose content is new; returns path → ``[CACHE]`` or ``[SKIP]``."""
        cached = {_bare(r.source) for r in self.intake(paths).where("status = '[CACHE]'").collect()}  # the outcome
        return {p: "[CACHE]" if _bare(p) in cached else "[SKIP]" for p in paths}

    def intake(self, paths: list[str]) -> DataFrame:
        """Store the files whose content is new; source, fingerprint, status, n_rows, n_rejected of every file.

        All files are sniffed, read and written together, whatever their formats and layouts, so the number of jobs does
        not grow with them. Rows go before the manifest and replace what a broken run left, so that a repeated run ends
        in the same state. Files without a line have no row here.
        """
        ensure_checkpoint_dir(self.spark)
        found = file_fingerprints(self.spark, paths).withColumnRenamed("path", "source")
        outcome = with_status(found, self.manifest(), "fingerprint", "source").checkpoint()  # a row for each file
        fresh = outcome.where("status = '[CACHE]'").select("source", "fingerprint")
        names = [r.source for r in fresh.select("source").collect()]  # as the caller's list of paths
        if names:
            self._store(names, fresh)
        counts = self.manifest().select("fingerprint", "n_rows", "n_rejected")
        return outcome.select("source", "fingerprint", "status").join(counts, "fingerprint", "left")

    def _store(self, paths: list[str], fresh: DataFrame) -> None:
        lines = records.numbered_lines(self.spark, [unquote(p) for p in paths])
        files = records.layouts(lines).checkpoint()  # a row for each file
        width, json_files = files.agg(F.max(F.size("names")), F.count_if("is_json")).first()
        parts = [records.delimited_rows(lines, files, width)] if width else []
        named = files.where("NOT is_json").select("path", "names")
        if json_files:
            objects = records.json_rows(lines, files)
            parts.append(objects)
            keys = objects.select("path", F.explode("names").alias("name"))
            named = named.unionAll(keys.groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("names")))
        named = named.checkpoint()
        columns = [r.name for r in named.select(F.explode("names").alias("name")).distinct().orderBy("name").collect()]  # the schema
        if parts:
            keyed = reduce(DataFrame.unionAll, parts).join(ranking.broadcast_if_small(fresh.withColumnRenamed("source", "path")), "path")
            rejected = F.col("bad_row").isNotNull()
            good = keyed.withColumn("values", F.when(~rejected, F.col("values")))
            wide = records.by_name(
                good, columns, F.col("bad_row").alias("_bad_row"), rejected.alias("rejected"), F.col("fingerprint").alias("dataset_hash")
            )
            (
                wide.write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("rejected", "dataset_hash")
                .parquet(self.data)
            )
        written = self._stored("_bad_row string, rejected boolean, dataset_hash string", self.data)
        counts = written.groupBy(F.col("dataset_hash").alias("fingerprint")).agg(
            F.count_if(~F.col("rejected")).alias("n_rows"), F.count_if("rejected").alias("n_rejected")
        )
        lines_of = named.select(F.col("path").alias("source"), F.to_json("names").alias("columns"))
        none = {"columns": "[]", "n_rows": 0, "n_rejected": 0}
        listed = fresh.join(lines_of, "source", "left").join(counts, "fingerprint", "left").fillna(none)
        listed.select("fingerprint", "source", "columns", "n_rows", "n_rejected").write.mode("append").parquet(self.manifest_path)

    def rejected(self) -> DataFrame:
        """dataset_hash, _bad_row of every row that could not be read."""
        stored = self._stored("_bad_row string, rejected boolean, dataset_hash string", self.data)
        return stored.where("rejected").select("dataset_hash", "_bad_row")

    def columns(self) -> list[str]:
        """All column names of the history, in order of first appearance by source and place."""
        listed = self.manifest().select("source", F.posexplode(F.from_json("columns", "array<string>")).alias("place", "name"))
        first = listed.groupBy("name").agg(F.min(F.struct("source", "place")).alias("first"))
        return [r.name for r in first.orderBy("first").collect()]  # the schema

    def load(self) -> DataFrame:
        """All data sets as one table by column name; a column a set lacks is null there.

        The schema comes from the manifest, so no file footer is opened to find it.
        """
        columns = self.columns()
        if not columns:
            raise RuntimeError("the history holds no data set")
        schema = ", ".join([f"`{x}` string" for x in columns] + ["rejected boolean", "dataset_hash string"])
        return self._stored(schema, self.data).where("NOT rejected").drop("rejected")


def _bare(path: str) -> str:
    """A path without its scheme, so that ``file:/a``, ``file:///a`` and ``/a`` are one."""
    head, sep, tail = path.partition(":/")
    return "/" + tail.lstrip("/") if sep and head.isalnum() else path
