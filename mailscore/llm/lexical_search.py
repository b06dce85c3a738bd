"""Ranked lexical search of every document for a set of stated queries, by dense blocked matrix products.

Queries come in blocks of a bounded number of terms. A block's distinct terms are its vocabulary, and documents are read
once for a block: what stays of a document is its id, its number of terms, and its counts of vocabulary terms. The
vocabulary is cut into tiles. A tile of query weights (query x term) times a tile of document impacts (term x document)
is one product of float64 matrices. Weights and impacts are whole numbers and a tile ends before the weights of any query
in it, times the largest impact, could reach 2^53, so every partial sum is exact in whatever order the library adds; the
sums of tiles are added as 64-bit integers. Of every tile of scores the best are kept, equal scores by smaller id.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailscore.llm.blocks import byte_texts, terms_of
from mailscore.session import ensure_checkpoint_dir

TOP = 10
BLOCK_TERMS = 400_000  # terms of the queries of a block, which bounds what is sent to the tasks
TILE_TERMS = 2048  # most columns of a vocabulary tile
TILE_DOCS = 512
TILE_QUERIES = 512
IMPACT = 1_000_000  # the impact of a term is below this: 10^9 tf / (10^3 tf + 8 m)
EXACT = 1 << 53

POSTS = "doc_id long, n long, terms binary, counts binary"


def blocks_of(items: DataFrame, most: int = BLOCK_TERMS):
    """Lists of queries (item_id, terms) with at most ``most`` terms in all, or a single longer one.

    Rows are streamed to the driver a partition at a time; a block at once is all that is held.
    """
    block, size = [], 0
    for row in items.toLocalIterator():
        terms = terms_of((row["text"] or "").encode("utf-8", "replace"))
        if block and size + len(terms) > most:
            yield block
            block, size = [], 0
        block.append((row["item_id"], terms))
        size += len(terms)
    if block:
        yield block


def posted(texts: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row (doc_id, n, terms, counts) for every document with a term: how many it has, and the number and count of each
    that is in the vocabulary. A row whose n is negative sums up a task: the documents that hold a term, and, as term -1,
    the documents with any term and all of their terms."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)  # BLOCK_TERMS entries at most

    def run(batches):
        get = shared.value.get
        held, documents, length = np.zeros(len(shared.value), np.int64), 0, 0
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for doc, text in zip(batch["doc_id"].to_pylist(), byte_texts(batch), strict=True):
                words = terms_of(text)
                if not words:
                    continue
                found = np.fromiter((i for i in map(get, words) if i is not None), np.int32)
                terms, counts = np.unique(found, return_counts=True)
                held[terms] += 1
                documents, length = documents + 1, length + len(words)
                for column, x in zip(columns, (doc, len(words), terms.tobytes(), counts.astype(np.int64).tobytes()), strict=True):
                    column.append(x)
            yield _posts(*columns)
        known = np.flatnonzero(held)
        ids = np.concatenate([known.astype(np.int32), np.array([-1, -2], np.int32)])
        yield _posts([None], [-1], [ids.tobytes()], [np.concatenate([held[known], np.array([documents, length], np.int64)]).tobytes()])

    return texts.mapInArrow(run, POSTS)


def _posts(doc, n, terms, counts) -> pa.RecordBatch:
    arrays = [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "terms", "counts"])


def statistics(posts: DataFrame) -> dict[int, int]:
    """Number of documents that hold a term, by term; N under -1 and L under -2. At most a row for each term."""

    def unpack(batches):
        for batch in batches:
            for terms, counts in zip(batch["terms"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                arrays = [pa.array(np.frombuffer(terms, np.int32)), pa.array(np.frombuffer(counts, np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["term", "n"])

    rows = posts.where("n < 0").select("terms", "counts").mapInArrow(unpack, "term int, n long")
    return {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def weight(held: int, total: int) -> int:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))"""
    return math.floor(1000 * math.log((2 * total + 2) / (2 * held + 1)))


@dataclass(frozen=True)
class Tile:
    """The weights of some queries, in a row from ``first`` on, for some terms; the matrix itself is made where it is used."""

    first: int
    queries: int
    terms: np.ndarray
    query: np.ndarray  # of every weight, counted from the first
    column: np.ndarray  # of every weight, a place in terms
    weight: np.ndarray


def tiles(queries: list[Counter], weights: np.ndarray, tall: int = TILE_QUERIES, widest: int = TILE_TERMS) -> list[Tile]:
    """Tiles of at most ``tall`` queries and ``widest`` terms, in which the weights of any query stay exact when summed.

    A weight that alone would pass the bound is shared by several tiles.
    """
    room, out = EXACT // IMPACT - 1, []
    for first in range(0, len(queries), tall):
        some = queries[first : first + tall]
        columns: dict[int, list[tuple[int, int]]] = {}
        for q, counts in enumerate(some):
            for term, n in counts.items():
                columns.setdefault(term, []).append((q, n * int(weights[term])))
        used, terms, parts = [0] * len(some), [], []

        def close():
            flat = [(q, k, w) for k, part in enumerate(parts) for q, w in part]
            query, column, value = (np.array(x, np.int64) for x in zip(*flat, strict=True))
            out.append(Tile(first, len(some), np.array(terms, np.int64), query, column, value.astype(np.float64)))

        for term in sorted(columns):
            left = [(q, w) for q, w in columns[term] if w]
            while left:
                part = [(q, min(w, room)) for q, w in left]
                if terms and (len(terms) == widest or any(used[q] + w > room for q, w in part)):
                    close()
                    used, terms, parts = [0] * len(some), [], []
                for q, w in part:
                    used[q] += w
                terms.append(term)
                parts.append(part)
                left = [(q, w - room) for q, w in left if w > room]
        if terms:
            close()
    return out


def impacts(counts: np.ndarray, n: np.ndarray, total: int, length: int) -> np.ndarray:
    """(10^9 tf) div (10^3 tf + 8 m) with m = 25 + (75 n N) div L, in whole numbers."""
    m = np.array([25 + 75 * x * total // length for x in n.tolist()], np.int64) if len(n) else np.zeros(0, np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


class Best:
    """The best documents of every query so far, by score and then by id."""

    def __init__(self, queries: int, top: int):
        self.top, self.queries = top, queries
        self.query, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.zeros(queries, np.int64)  # a score has to be above it, or equal with a smaller id
        self.last = np.full(queries, np.iinfo(np.int64).min)

    def add(self, first: int, scores: np.ndarray, docs: np.ndarray) -> None:
        """scores: query x document, of the queries from ``first`` on."""
        floor, last = (x[first : first + len(scores), None] for x in (self.floor, self.last))
        query, at = np.nonzero((scores > floor) | ((scores == floor) & (docs[None, :] < last)))
        if not len(query):
            return
        touched = (self.query >= first) & (self.query < first + len(scores))
        doc = np.concatenate([self.doc[touched], docs[at]])
        score = np.concatenate([self.score[touched], scores[query, at]])
        query = np.concatenate([self.query[touched], query + first])
        order = np.lexsort((doc, -score, query))
        query, score, doc = query[order], score[order], doc[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep, full = place < self.top, place == self.top - 1
        self.floor[query[full]], self.last[query[full]] = score[full], doc[full]
        self.query = np.concatenate([self.query[~touched], query[keep]])
        self.score = np.concatenate([self.score[~touched], score[keep]])
        self.doc = np.concatenate([self.doc[~touched], doc[keep]])


def best_documents(posts: DataFrame, queries: list[Counter], stats: dict[int, int], top: int = TOP) -> DataFrame:
    """(query, doc_id, score): the best of every query among the documents of each task."""
    total, length = stats.get(-1, 0), stats.get(-2, 0)
    size = max((t for q in queries for t in q), default=-1) + 1
    weights = np.array([weight(stats.get(t, 0), total) for t in range(size)], np.int64)
    cut = tiles(queries, weights)
    shared = posts.sparkSession.sparkContext.broadcast(cut)  # as large as the block's queries x terms allow

    def run(batches):
        best = Best(len(queries), top)
        for batch in batches:
            ids, n = batch["doc_id"].to_numpy(zero_copy_only=False), batch["n"].to_numpy(zero_copy_only=False)
            terms = [np.frombuffer(t, np.int32) for t in batch["terms"].to_pylist()]
            counts = [np.frombuffer(c, np.int64) for c in batch["counts"].to_pylist()]
            for start in range(0, len(ids), TILE_DOCS):
                _score(best, shared.value, ids, n, terms, counts, slice(start, start + TILE_DOCS), total, length, size)
        arrays = [pa.array(x) for x in (best.query, best.doc, best.score)]
        yield pa.RecordBatch.from_arrays(arrays, names=["query", "doc_id", "score"])

    rows = posts.where("n > 0 AND doc_id IS NOT NULL AND length(terms) > 0")
    return rows.mapInArrow(run, "query long, doc_id long, score long")


def _score(best: Best, cut: list[Tile], ids, n, terms, counts, part: slice, total: int, length: int, size: int) -> None:
    ids, n, terms, counts = ids[part], n[part], terms[part], counts[part]
    sizes = np.array([len(t) for t in terms], np.int64)
    row, term = np.repeat(np.arange(len(ids)), sizes), np.concatenate(terms).astype(np.int64)
    value = impacts(np.concatenate(counts), np.repeat(n, sizes), total, length)
    scores, first = None, -1
    place = np.full(size, -1, np.int64)
    for tile in cut:
        if tile.first != first:
            if scores is not None:
                best.add(first, scores, ids)
            scores, first = np.zeros((tile.queries, len(ids)), np.int64), tile.first
        place[tile.terms] = np.arange(len(tile.terms))
        column = place[term]
        held = column >= 0
        place[tile.terms] = -1
        live, column = np.unique(column[held], return_inverse=True)  # of the tile only the terms that the documents hold
        at = np.full(len(tile.terms), -1, np.int64)
        at[live] = np.arange(len(live))
        dense = np.zeros((len(live), len(ids)))
        dense[column, row[held]] = value[held]
        used = at[tile.column] >= 0
        matrix = np.zeros((tile.queries, len(live)))
        matrix[tile.query[used], at[tile.column[used]]] = tile.weight[used]
        scores += (matrix @ dense).astype(np.int64)
    if scores is not None:
        best.add(first, scores, ids)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents with the highest score above 0 for every item.

    An item is a distinct row (item_id, text) of ``items``; without a term (null, empty text) it finds nothing. Documents
    without a term count nowhere. Rows that share an id are ranked each; rows without an id count in the statistics and
    are not ranked. Empty tables give an empty result. Further columns are not looked at.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    texts = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").where("text IS NOT NULL")
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for block in blocks_of(items.select("item_id", "text").distinct(), block_terms):
        found = _search_block(spark, texts, block, top, kind)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out


def _search_block(spark: SparkSession, texts: DataFrame, block: list, top: int, kind: str) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    queries = [Counter(vocabulary[t] for t in terms) for _, terms in block]
    posts = posted(texts, vocabulary).checkpoint()  # read for the statistics, then for the scores
    found = best_documents(posts, queries, statistics(posts), top)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ids = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], f"query long, item_id {kind}")
    return ranked.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score")
