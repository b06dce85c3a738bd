"""Files as records, in a fixed number of jobs however many files there are and however large one is.

Lines are read with their file, split and place. A line of a delimited file either begins inside a quoted field or not,
and what it does to that state is one of four functions: keep it, turn it round, or set it to one of its values. The
functions of the lines of a split are put together by a running sum of the turns since the last line that sets the state,
those of the splits of a file likewise, so every line learns its state without any task reading a whole file. Lines up
to the next one that begins outside a field are one record; only records that reach over a split's end are put together
in a second step. JSON files are read by the same lines.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mailscore import constants as c
from mailscore.operators.ranking import broadcast_if_small

SNIFF_LINES = 20
SPLIT = ["path", "block"]
BOM = "﻿"


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, block (where the split begins), id (ascending within a split) and value of every line."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )


def _by_sep(make) -> Column:
    """The value that belongs to the separator of the row."""
    chain = F.when(F.col("sep") == c.SEPARATORS[0], make(c.SEPARATORS[0]))
    for sep in c.SEPARATORS[1:]:
        chain = chain.when(F.col("sep") == sep, make(sep))
    return chain


def _readable(value: Column, utf8: Column) -> Column:
    return F.when(utf8, value).otherwise(F.decode(value.cast("binary"), "ISO-8859-1"))


def _separator(rows: Column) -> Column:
    """The separator that cuts the sample into the most, evenly wide, rows; quoted parts do not count."""

    def rank(place: int, sep: str) -> Column:
        widths = F.transform(rows, lambda r: F.length(r) - F.length(F.replace(r, F.lit(sep), F.lit(""))) + 1)
        first = F.coalesce(F.get(widths, F.lit(0)), F.lit(0))
        even = F.size(F.filter(widths, lambda x: x == first))
        wide = first > 1
        return F.struct(F.when(wide, even).otherwise(0), F.when(wide, first).otherwise(0), F.lit(-place), F.lit(sep).alias("sep"))

    ranks = [rank(place, sep) for place, sep in enumerate(c.SEPARATORS)]
    return F.array_max(F.array(*ranks))["sep"]


def _names(header: Column, sep: str) -> Column:
    """Field names of a header line: trimmed, in lower case, unnamed and repeated ones told apart by their place."""
    s = re.escape(sep)
    raw = F.regexp_extract_all(header, F.lit(rf'(?:^|{s})("(?:[^"]++|"")*+"|[^{s}]*+)'), F.lit(1))
    bare = F.transform(raw, lambda n: F.when(F.startswith(n, F.lit('"')), F.replace(F.substring(n, F.lit(2), F.length(n) - 2), F.lit('""'), F.lit('"'))).otherwise(n))
    clean = F.transform(bare, lambda n: F.lower(F.trim(n)))
    return F.transform(
        clean, lambda n, i: F.when((n == "") | (F.array_position(clean, n) <= i), F.concat(n, F.lit("_"), (i + 1).cast("string"))).otherwise(n)
    )


def layouts(lines: DataFrame, sep: str | None = None) -> DataFrame:
    """path, is_json, is_array, utf8, sep, header_id, names of every file that has a line with a character.

    The first SNIFF_LINES lines decide on separator and header, the first character on a JSON file being an array, all
    lines on the encoding (UTF-8, else ISO 8859-1). The columns of JSON files are not known here: names is null.
    """
    order = W.partitionBy("path").orderBy("id")
    head = lines.where("block = 0").withColumn("n", F.row_number().over(order)).where(F.col("n") <= SNIFF_LINES)
    heads = head.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("id", "value"))).alias("head"))
    codes = lines.groupBy("path").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    filled = F.filter("head", lambda x: F.trim(x["value"]) != "")
    files = heads.join(codes, "path").withColumn("head", filled).where("size(head) > 0")
    text = F.ltrim(F.replace(F.array_join(F.transform("head", lambda x: _readable(x["value"], F.col("utf8"))), "\n"), F.lit(BOM), F.lit("")))
    files = files.select(
        "path",
        "utf8",
        F.endswith(F.lower("path"), F.lit(".json")).alias("is_json"),
        F.startswith(text, F.lit("[")).alias("is_array"),
        F.col("head")[0]["id"].alias("header_id"),
        text.alias("text"),
        F.replace(text, F.lit('""'), F.lit("")).alias("bare"),
    )
    rows = F.filter(F.split(F.regexp_replace("bare", '"[^"]*+(?:"|$)', ""), "\n"), lambda r: r != "")
    chosen = files.withColumn("sep", F.lit(sep) if sep else _separator(rows))
    header = F.regexp_extract("text", r'^(?:[^"\n]++|"[^"]*+"?)*+', 0)
    names = F.when(~F.col("is_json"), _by_sep(lambda s: _names(header, s)))
    return chosen.select("path", "is_json", "is_array", "utf8", "sep", "header_id", names.alias("names"))


def _effects(value: Column) -> tuple[Column, Column]:
    """Whether a line that begins outside (inside) a quoted field ends inside one.

    Runs of quotes stand for their parity first, so any quote that is left opens or closes. As the reader has it, a quote
    opens a field only at its beginning, and what follows a closing quote belongs to the field up to the separator.
    """
    bare = F.replace(value, F.lit('""'), F.lit(""))

    def fields(sep: str) -> str:
        s = re.escape(sep)
        return rf'(?:(?:"[^"]*+"[^{s}]*+|[^{s}"][^{s}]*+)?{s})*+"[^"]*+$'

    outside = _by_sep(lambda s: F.rlike(bare, F.lit(rf"(?s)^{fields(s)}")))
    inside = _by_sep(lambda s: F.rlike(bare, F.lit(rf'(?s)^[^"]*+(?:$|"[^{re.escape(s)}]*+{re.escape(s)}{fields(s)})')))
    return outside, inside


def _run(lines: DataFrame) -> DataFrame:
    """Adds turns (odd if the state is turned an odd number of times so far) and set (the last value it was set to, and
    the turns until then), from the beginning of the split to the line itself."""
    sofar = W.partitionBy(*SPLIT).orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    turns = lines.withColumn("turns", F.sum((F.col("outside") & ~F.col("inside")).cast("int")).over(sofar))
    fixed = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").alias("value"), F.col("turns").alias("at")))
    return turns.withColumn("set", F.last(fixed, ignorenulls=True).over(sofar))


def _turned(value: Column, turns: Column) -> Column:
    return value != (turns % 2 == 1)


def delimited_records(lines: DataFrame, files: DataFrame) -> DataFrame:
    """path, block, id (of the first line), text of every record of the delimited files; ``files`` as from layouts()."""
    known = broadcast_if_small(files.where("NOT is_json").select("path", "sep", "utf8"))
    outside, inside = _effects(F.col("value"))
    typed = lines.join(known, "path").withColumns({"outside": outside, "inside": inside})

    ends = _run(typed.select(*SPLIT, "id", "outside", "inside")).groupBy(*SPLIT).agg(F.max_by(F.struct("set", "turns"), "id").alias("end"))
    fixed = F.when(F.col("end.set").isNotNull(), _turned(F.col("end.set.value"), F.col("end.turns") - F.col("end.set.at")))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    splits = ends.select(*SPLIT, fixed.alias("value"), F.when(fixed.isNull(), F.col("end.turns")).otherwise(0).alias("own"))
    splits = splits.withColumn("sum", F.coalesce(F.sum("own").over(before), F.lit(0)))
    last = F.last(F.when(F.col("value").isNotNull(), F.struct("value", "sum")), ignorenulls=True).over(before)
    starts = splits.withColumn("last", last).select(
        *SPLIT,
        F.when(F.col("last").isNotNull(), _turned(F.col("last.value"), F.col("sum") - F.col("last.sum"))).otherwise(F.col("sum") % 2 == 1).alias("begins"),
    )

    placed = _run(typed).join(broadcast_if_small(starts), SPLIT)
    after = F.when(F.col("set").isNotNull(), _turned(F.col("set.value"), F.col("turns") - F.col("set.at"))).otherwise(
        _turned(F.col("begins"), F.col("turns"))
    )
    order = W.partitionBy(*SPLIT).orderBy("id")
    opened = placed.withColumn("ends", after).withColumn("opens", ~F.coalesce(F.lag("ends").over(order), F.col("begins")))
    counted = opened.withColumn("record", F.sum(F.col("opens").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    line = F.struct("id", _readable(F.col("value"), F.col("utf8")).alias("value"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["value"]), "\n")
    parts = counted.groupBy(*SPLIT, "record").agg(
        text.alias("text"), F.min("id").alias("id"), F.min_by("opens", "id").alias("opens"), (~F.max_by("ends", "id")).alias("closed")
    )
    whole = parts.where("opens AND closed").select("path", "block", "id", "text")
    # at most two for each split: what began in an earlier one, and what goes on in the next
    chain = F.sum(F.col("opens").cast("int")).over(W.partitionBy("path").orderBy("block", "record").rowsBetween(W.unboundedPreceding, 0))
    broken = parts.where("NOT (opens AND closed)").withColumn("chain", chain)
    piece = F.array_sort(F.collect_list(F.struct("block", "record", "text")))
    joined = broken.groupBy("path", "chain").agg(
        F.min("block").alias("block"), F.min_by("id", F.struct("block", "record")).alias("id"), F.array_join(F.transform(piece, lambda x: x["text"]), "\n").alias("text")
    )
    return whole.unionAll(joined.select("path", "block", "id", "text")).where("text <> ''")


def delimited_rows(lines: DataFrame, files: DataFrame, width: int) -> DataFrame:
    """path, names, values, bad_row of the records below the header; ``width`` is that of the widest header.

    A record with too many fields is a bad row, one with too few has nulls.
    """
    schema = ", ".join(f"c{i} string" for i in range(width + 1))
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1", "maxColumns": str(max(20480, 2 * width)), "multiLine": "true"}
    known = broadcast_if_small(files.select("path", "sep", "header_id", "names"))
    records = delimited_records(lines, files).join(known, "path").where("NOT (block = 0 AND id = header_id)")
    parsed = records.withColumn("fields", _by_sep(lambda s: F.from_csv("text", schema, options | {"sep": s})))
    fields = parsed.withColumn("fields", F.array(*[F.col(f"fields.c{i}") for i in range(width + 1)]))
    beyond = F.get("fields", F.size("names")).isNotNull()
    return fields.select("path", "names", F.expr("slice(fields, 1, size(names))").alias("values"), F.when(beyond, F.col("text")).alias("bad_row"))


def json_rows(lines: DataFrame, files: DataFrame, raw_names: bool = False) -> DataFrame:
    """path, names, values, bad_row of the objects of the JSON files: one on each line, or all in one array.

    Numbers, truth values and nested parts become the text that JSON has for them. A line (or a whole array file) that cannot be
    read is a bad row. An array file is put together in one task, as it has no line that a reader could begin at.
    """
    known = broadcast_if_small(files.where("is_json").select("path", "is_array", "utf8"))
    texts = lines.join(known, "path").withColumn("value", F.replace(_readable(F.col("value"), F.col("utf8")), F.lit(BOM), F.lit("")))
    single = texts.where("NOT is_array AND trim(value) <> ''").select("path", F.col("value").alias("text"))
    line = F.array_sort(F.collect_list(F.struct("block", "id", "value")))
    files_ = texts.where("is_array").groupBy("path").agg(F.array_join(F.transform(line, lambda x: x["value"]), "\n").alias("text"))
    read = single.withColumn("object", F.from_json("text", "map<string,string>"))
    listed = files_.withColumn("objects", F.from_json("text", "array<map<string,string>>"))
    unreadable = F.col("objects").isNull() | (F.size(F.filter("objects", lambda x: x.isNull())) > 0)
    exploded = listed.select("path", F.when(unreadable, F.col("text")).alias("text"), F.explode_outer("objects").alias("object"))
    keys = F.map_keys("object") if raw_names else F.transform(F.map_keys("object"), lambda n: F.lower(F.trim(n)))

    def shaped(df: DataFrame, bad: Column) -> DataFrame:
        return df.select("path", keys.alias("names"), F.map_values("object").alias("values"), bad.alias("bad_row"))

    return shaped(read, F.when(F.col("object").isNull(), F.col("text"))).unionAll(
        shaped(exploded.where("object IS NOT NULL OR text IS NOT NULL"), F.when(F.col("object").isNull(), F.col("text")))
    )


def by_name(rows: DataFrame, columns: list[str], *keep: str | Column) -> DataFrame:
    """The values of rows (names, values) as columns; null where a row has no such name. The first of equal names counts."""
    value = [F.try_element_at("values", F.nullif(F.array_position("names", n).cast("int"), F.lit(0))).alias(n) for n in columns]
    return rows.select(*keep, *value)
