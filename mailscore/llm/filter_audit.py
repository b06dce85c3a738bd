"""How five filters interact: what each one removes under every order in which they can be applied.

A document is only known by its mask, the set of filters that it fails, so the corpus is first counted by part, mask and
label. An order is a permutation of the filters, known by its lexicographic rank. A mask is removed at the first of its
filters in an order: all orders that begin with certain filters outside the mask and go on with a certain one of it are
one interval of ranks, as permutations with a common beginning are neighbours. The counts of a mask are therefore added
at the start of each of its intervals and taken off behind the end (at most 65 intervals for a mask), and a running sum over the 120 ranks gives the
removals of every order and step.
"""

from __future__ import annotations

import hashlib
from itertools import combinations, permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailscore.llm.blocks import byte_texts
from mailscore.session import ensure_checkpoint_dir

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # percent of the words
MOST_CAPITALS = 3  # percent of the code points
MARKS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
INSIDE = bytes(range(0x80, 0xC0))  # bytes of a code point after its first


def own_failures(text: bytes) -> int:
    """Bits 0 to 3: the filters A to D that a text fails by itself."""
    words = text.split()  # at runs of \x20 and \x09 to \x0D
    n = len(words)
    short = n < LEAST_WORDS
    repeated = 100 * len(set(words)) < LEAST_DISTINCT * n
    loud = 100 * (len(text) - len(text.translate(None, CAPITALS))) > MOST_CAPITALS * len(text.translate(None, INSIDE))
    marked = len(text.translate(None, MARKS)) < len(text)
    return short | repeated << 1 | loud << 2 | marked << 3


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, mask of every row; bit i of the mask is set where the row fails filter i of A to E.

    A null text is an empty one, a null part the empty string. Texts are compared by their SHA-256: of a text's rows, all
    whose id is larger than the smallest id fail E, so repeated rows of the smallest id pass and rows without an id
    neither fail E nor make another row fail it.
    """

    def judge(batches):
        for batch in batches:
            texts = byte_texts(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], batch["part"], pa.array(map(own_failures, texts), pa.int32()),
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                ],
                names=["doc_id", "part", "own", "digest"],
            )

    texts = docs.selectExpr(
        f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"coalesce(CAST(`{part_col}` AS STRING), '') AS part", f"`{text_col}` AS text"
    )
    ensure_checkpoint_dir(docs.sparkSession)
    judged = texts.mapInArrow(judge, "doc_id long, part string, own int, digest binary").checkpoint()  # texts are read once
    # a text with a third of all rows is one row of every task here, and the join takes the id as well, so it is spread
    first = judged.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("passes", F.lit(True))
    joined = judged.join(first, ["digest", "doc_id"], "left")
    late = (F.col("doc_id").isNotNull() & F.col("passes").isNull()).cast("int")
    return joined.select("doc_id", "part", (F.col("own") + late * 16).alias("mask"))


def intervals() -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank behind the last): where the orders that remove a mask at a step lie."""
    n, out = len(FILTERS), []
    for size in range(1, n + 1):
        for failed in combinations(range(n), size):
            passed = [i for i in range(n) if i not in failed]
            for before in range(len(passed) + 1):
                width = factorial(n - before - 1)
                for head in permutations(passed, before):
                    for last in failed:
                        rank, left = 0, list(range(n))
                        for place, i in enumerate((*head, last)):
                            rank += left.index(i) * factorial(n - place - 1)
                            left.remove(i)
                        out.append((sum(1 << i for i in failed), before + 1, rank, rank + width))
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step and the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A row for every part, order and step, zeros included; an empty table gives none. ``labels`` has an id, quality and
    toxic; several rows of an id are one, good (toxic) if any of them is. Rows without a label or an id are in no
    class of it. Further columns are not looked at.
    """
    spark = docs.sparkSession
    marks = labels.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", "quality", "toxic").where("doc_id IS NOT NULL")
    marks = marks.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad")
    )
    rows = masks(docs, id_col, text_col, part_col).join(marks.where("good OR bad"), "doc_id", "left")
    # 32 masks of a part: from here on the tables have the size of the answer
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("bad").alias("bad"))
    counts = counts.checkpoint()

    fails = [F.sum(F.expr(f"IF((mask & {1 << i}) > 0, n, 0)")) for i in range(len(FILTERS))]
    alone = [F.sum(F.expr(f"IF(mask = {1 << i}, n, 0)")) for i in range(len(FILTERS))]
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone"))

    sums = ["n", "good", "bad"]
    ends = spark.createDataFrame(
        [(m, s, rank, sign) for m, s, lo, hi in intervals() for rank, sign in ((lo, 1), (hi, -1))], "mask int, step int, rank int, sign int"
    )
    deltas = counts.join(F.broadcast(ends), "mask")  # 1,680 fixed rows
    deltas = deltas.groupBy("part", "step", "rank").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in sums])

    orders = ["".join(p) for p in permutations(FILTERS)]  # in lexicographic order, so an order's place is its rank
    names = F.array(*[F.lit(o) for o in orders])
    grid = parts.select(
        "part", "total", "fails", "alone", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("rank")
    ).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    running = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # 120 rows
    filled = grid.join(deltas, ["part", "step", "rank"], "left")
    summed = filled.select(
        "part", "total", "fails", "alone", "rank", "step", F.element_at(names, F.col("rank") + 1).alias("filter_order"),
        *[F.sum(F.coalesce(c, F.lit(0))).over(running).alias(c) for c in sums],
    ).withColumn("filter", F.instr(F.lit(FILTERS), F.expr("substring(filter_order, step, 1)")))
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    failing = F.element_at("fails", F.col("filter"))
    return summed.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.sum("n").over(so_far)).alias("kept"),
        F.col("n").alias("removed"),
        (failing - F.col("n")).alias("redundant"),
        F.element_at("alone", F.col("filter")).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("bad").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )
