"""Readers for labelled data sets in differing formats.

All columns are read as strings: types are settled later by name, so that sets
with differing types can be kept in one history.
"""

from __future__ import annotations

import csv
import io
import os
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailscore import constants as c
from mailscore.functions.mime import valid_text
from mailscore.sources import records

SNIFF_LINES = 20
BAD_ROW = "_bad_row"

FILES_AT_ONCE, BYTES_AT_ONCE = 500, 8 << 20  # raw messages that a task holds


@dataclass(frozen=True)
class Layout:
    """What must be known to read a delimited file."""

    sep: str
    columns: tuple[str, ...]
    utf8: bool


def spread(df: DataFrame, small: int = 1_000_000) -> DataFrame:
    """A small table that lies in a few files, spread over all cores.

    A Parquet file of one row group is one task, however many cores are idle. A
    table of many files, or of many rows (counted from the file footers), is
    left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or df.count() > small:
        return df
    return df.repartition(cores)


def suffix_of(path: str) -> str:
    return os.path.splitext(path)[1].lower()


def is_dataset_file(path: str) -> bool:
    return suffix_of(path) in c.DATASET_SUFFIXES


def list_dataset_files(spark: SparkSession, folder: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, length, modified of all data-set files below a folder, but for excluded folders.

    Only the listing is read: the content column is pruned.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )
    bare = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    suffix = F.lower(F.regexp_extract(bare, r"(\.[^./]*)$", 1))
    kept = listed.where(suffix.isin(c.DATASET_SUFFIXES))
    for place in exclude:
        kept = kept.where(~F.startswith(bare, F.lit(os.path.join(place, ""))))
    return kept.orderBy("path")


def sniff_separator(lines: list[str]) -> str:
    """The separator that cuts the sample into the most, evenly wide, rows."""
    best, best_rank = c.SEPARATORS[0], (0, 0)
    for sep in c.SEPARATORS:
        rows = [r for r in csv.reader(io.StringIO("\n".join(lines)), delimiter=sep) if r]
        width = len(rows[0]) if rows else 0
        rank = (sum(len(r) == width for r in rows), width) if width > 1 else (0, 0)
        if rank > best_rank:
            best, best_rank = sep, rank
    return best


def layout_of(spark: SparkSession, path: str, sep: str | None = None) -> Layout:
    """Separator and header from the first lines; the encoding from the whole file, in one parallel pass."""
    lines = spark.read.text(path)
    head = [r.line for r in lines.select(F.decode(F.encode("value", "UTF-8"), "UTF-8").alias("line")).head(SNIFF_LINES)]
    if not head:
        raise ValueError(f"empty file: {path}")
    sep = sep or sniff_separator(head)
    header = next(csv.reader(io.StringIO("\n".join(head)), delimiter=sep))
    utf8 = lines.agg(F.bool_and(F.is_valid_utf8("value"))).first()[0]
    header[0] = header[0].removeprefix("﻿")
    return Layout(sep, tuple(header), bool(utf8))


def read_delimited(
    spark: SparkSession, paths: str | list[str], layout: Layout, multiline: bool = True, with_path: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected rows) of files that share a layout.

    Rows with too many fields are rejected, rows with too few are filled with
    nulls. Files in both encodings are read byte for byte and decoded after the
    split, as separators and quotes are plain ASCII. A file with line breaks
    inside fields is read by as many tasks as it has splits (see records);
    where there are none, ``multiline=False`` saves the shuffle that needs.
    """
    extra = ["_path"] if with_path else []
    if multiline:
        lines = records.numbered_lines(spark, paths)
        names = F.array(*[F.lit(n) for n in layout.columns])
        files = records.layouts(lines, layout.sep).withColumns({"utf8": F.lit(layout.utf8), "is_json": F.lit(False), "names": names})
        rows = records.delimited_rows(lines, files, len(layout.columns)).withColumnRenamed("path", "_path")
        values = [F.get("values", F.lit(i)).alias(n) for i, n in enumerate(layout.columns)]
        good, bad = rows.where("bad_row IS NULL"), rows.where("bad_row IS NOT NULL")
        return good.select(*values, *extra), bad.select(F.col("bad_row").alias(BAD_ROW), *extra)

    # one more column than the header: whatever lands in it marks an over-long row
    names = [f"c{i}" for i in range(len(layout.columns))]
    schema = ", ".join(f"`{n}` string" for n in [*names, "_extra"])
    raw = (
        spark.read.schema(schema)
        .option("sep", layout.sep)
        .option("header", "true")
        .option("enforceSchema", "true")
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "ISO-8859-1")
        .option("mode", "PERMISSIVE")
        .option("maxCharsPerColumn", "-1")
        .csv(paths)
    )
    if with_path:
        raw = raw.withColumn("_path", F.col("_metadata.file_path"))

    def text(name: str):
        value = F.col(name)
        return F.decode(F.encode(value, "ISO-8859-1"), "UTF-8") if layout.utf8 else value

    good = raw.where(F.col("_extra").isNull()).select(
        *[text(n).alias(column) for n, column in zip(names, layout.columns)], *extra
    )
    bad = raw.where(F.col("_extra").isNotNull()).select(
        F.concat_ws(layout.sep, *[text(n) for n in [*names, "_extra"]]).alias(BAD_ROW), *extra
    )
    return good, bad


def read_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON lines or one JSON array, as each file has it; every field as a string, columns by their names in order.

    Lines and files that cannot be read are left out; ``records.json_rows`` has them.
    """
    lines = records.numbered_lines(spark, path)
    files = records.layouts(lines).withColumn("is_json", F.lit(True))
    rows = records.json_rows(lines, files, raw_names=True).where("bad_row IS NULL")
    names = sorted(r.name for r in rows.select(F.explode("names").alias("name")).distinct().collect())  # the schema
    return records.by_name(rows, names)


def read_dataset(spark: SparkSession, path: str, fmt: str | None = None, multiline: bool = True) -> DataFrame:
    """A data set by its suffix (or the named format); an unknown one is an error."""
    kind = (fmt or suffix_of(path).lstrip(".")).lower()
    if kind in ("csv", "tsv", "txt"):
        return read_delimited(spark, path, layout_of(spark, path), multiline)[0]
    if kind == "json":
        return read_json(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type: {os.path.basename(path)}")


def read_quoted(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated file with every field quoted; over-long rows are left out."""
    return read_delimited(spark, path, layout_of(spark, path, sep=","))[0]


def read_raw_emails(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, text of raw message files; bytes that are no UTF-8 are dropped.

    Spark's reader of whole files keeps the names of all of them in the driver. On a disk that machines share, where
    messages are files by the million (``sinks.write_raw_messages``), tasks list the folders and read the files; the
    driver knows what ``folder`` itself names. Other stores are listed by Spark.
    """
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(hadoop)
    found = [x.getPath() for x in store.globStatus(place) or []] if store.getScheme() == "file" else []
    if not found:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    else:
        files = _files(spark, [(x.toString(), x.toUri().getPath()) for x in found], jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern())
    return files.select("path", valid_text(F.col("content")).alias("text"))


def _files(spark: SparkSession, places: list[tuple[str, str]], names: str) -> DataFrame:
    """path, content of the files among these places, or in these folders (and their partitions), whose name matches."""
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows, size = FILES_AT_ONCE, BYTES_AT_ONCE

    def below(path: str, local: str):
        for entry in os.scandir(local):
            if entry.is_dir():
                if "=" in entry.name and not entry.name.startswith("."):
                    yield from below(f"{path}/{entry.name}", entry.path)
            else:
                yield f"{path}/{entry.name}", entry.path

    def listed(batches):
        wanted = re.compile(names)
        for batch in batches:
            for path, local in zip(*(batch.column(x).to_pylist() for x in ("path", "local"))):
                held = []
                for file in below(path, local) if os.path.isdir(local) else [(path, local)]:
                    name = file[0].rpartition("/")[2]
                    hidden = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
                    if not hidden and wanted.fullmatch(name):
                        held.append(file)
                    if len(held) == rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*held)], ["path", "local"])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*held)], ["path", "local"])

    def read(batches):
        paths, contents, held = [], [], 0
        for batch in batches:
            for path, local in zip(*(batch.column(x).to_pylist() for x in ("path", "local"))):
                with open(local, "rb") as file:
                    contents.append(file.read())
                paths.append(path)
                held += len(contents[-1])
                if len(paths) == rows or held > size:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
                    paths, contents, held = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    folders = spark.createDataFrame(places, "path string, local string").repartition(min(len(places), tasks))
    return folders.mapInArrow(listed, "path string, local string").repartition(tasks).mapInArrow(read, "path string, content binary")
