"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Learning takes a bounded sample of labelled rows. Terms are words and the beginnings of longer ones, so that endings that
vary do not hide a stem. Terms that go together with the label (chi-squared over the sample, at a
level that allows for the number of terms) span the space; how rare a term is, is counted over all documents. The examples are sorted, so that alike
ones are neighbours, and cut into blocks; for every term the index has its postings and its largest weight in each block.
A text's blocks are visited by the largest similarity that they could hold, until the next block cannot reach the
nearest examples found so far, so these are the exact ones. Their votes, weighted by distance, are turned into a
probability by a logistic curve fitted to the examples, each judged by the others.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import chain
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscore.llm.blocks import byte_texts, crc_mod, terms_of
from mailscore.session import ensure_checkpoint_dir

EXAMPLES = 20_000  # labelled rows that are learnt from, at most
TERMS = 1024  # terms of the space, at most; with EXAMPLES this bounds the index
CHANCE = 0.05  # that any term is taken without going together with the label; shared among all terms that are tested
LEAST = 3  # examples that a term must stand in
STEMS = (4, 5, 6, 7)  # code points of the beginnings that are terms as well
KNOWN = 300_000  # words whose terms a task remembers
NEAREST = 25
BLOCK = 64  # examples of a block
SCALE = 1 << 20  # weights are rounded to this share of a vector's length; sums of products stay far below 2^53
AT_ONCE = 256  # vectors that are judged at once
NEAR = 0.05  # added to every distance, so that an equal example does not outvote all others
BELIEF = 1.0  # weight of the share of toxic examples among the votes


@dataclass(frozen=True)
class Index:
    """Weights are whole numbers, the length of a vector being SCALE, so that sums are exact whatever their order."""

    idf: np.ndarray  # of every term
    label: np.ndarray  # of every example, in the order of the blocks
    ids: np.ndarray  # doc_id of every example
    tops: np.ndarray  # term x block: the largest weight of a term in a block
    start: np.ndarray  # where a block's terms begin in ``terms``
    terms: np.ndarray  # the terms that a block's examples hold
    posts: np.ndarray  # a row for each of them: the weight in every example of the block
    base: float  # share of toxic examples
    blank: float  # share of toxic ones among the examples that hold no term
    slope: float
    shift: float

    def nearest(self, queries: np.ndarray, k: int = NEAREST, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and similarities (times SCALE squared) of the k nearest examples of every query (a row of weights).

        Nearest first, then in order of number; number -1 where fewer examples share a term. ``but`` has the number of the
        example that a query must not find.
        """
        bits = np.int64(max(1, len(self.label)).bit_length())
        low = (np.int64(1) << bits) - 1
        best = np.full((len(queries), k), -1, np.int64)  # similarity and, below it, how small the number is
        bounds = queries @ self.tops
        order = np.argsort(-bounds, axis=1, kind="stable")
        bounds = np.take_along_axis(bounds, order, axis=1)
        live, at, width = np.arange(len(queries)), 0, 4
        while at < self.tops.shape[1]:
            # a block that can hold an example as near as the last one kept has to be looked at
            live = live[(bounds[live, at] > 0) & (bounds[live, at] >= (best[live, -1] >> bits))]
            if not len(live):
                break
            chosen = order[live, at : at + width]
            room = np.full((len(live), chosen.shape[1] * BLOCK), -1, np.int64)
            row, slot = np.divmod(np.argsort(chosen, axis=None, kind="stable"), chosen.shape[1])
            block = chosen[row, slot]
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(block)], strict=True):
                part = slice(self.start[block[a]], self.start[block[a] + 1])
                found = queries[np.ix_(live[row[a:z]], self.terms[part])] @ self.posts[part]
                number = block[a] * BLOCK + np.arange(BLOCK)
                key = np.where(found > 0, found.astype(np.int64) << bits | low - number, -1)
                if but is not None:
                    key[number == but[live[row[a:z]], None]] = -1
                room[row[a:z, None], slot[a:z, None] * BLOCK + np.arange(BLOCK)] = key
            both = np.concatenate([best[live], room], axis=1)
            best[live] = -np.sort(-np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)
            at, width = at + width, 2 * width
        return np.where(best < 0, -1, low - (best & low)), np.where(best < 0, 0, best >> bits)

    def votes(self, number: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The share of toxic ones among the neighbours, each weighted by 1 / (distance + NEAR)."""
        weight = np.where(number < 0, 0, 1 / (np.maximum(1 - near / SCALE**2, 0) + NEAR))
        toxic = np.append(self.label, 0.0)[number]
        return ((weight * toxic).sum(axis=1) + BELIEF * self.base) / (weight.sum(axis=1) + BELIEF)

    def probability(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _odds(votes) + self.shift, -30, 30)))

    def rows(self, vectors: list[tuple[bytes, bytes]]) -> np.ndarray:
        """The weights of every (terms, counts), a row each."""
        out = np.zeros((len(vectors), len(self.idf)))
        for i, (terms, counts) in enumerate(vectors):
            out[i, np.frombuffer(terms, np.int32)] = weights(self.idf, terms, counts)
        return out


def weights(idf: np.ndarray, terms: bytes, counts: bytes) -> np.ndarray:
    """(1 + ln count) idf of the terms, scaled to the length SCALE and rounded."""
    w = idf[np.frombuffer(terms, np.int32)] * (1 + np.log(np.frombuffer(counts, np.int32)))
    return np.rint(w * (SCALE / np.sqrt((w * w).sum()))) if len(w) else w


def _odds(share):
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def build(examples: list[tuple[int, int, bytes, bytes]], idf: np.ndarray) -> tuple[Index, list[tuple[bytes, bytes]]]:
    """The index of (doc_id, label, terms, counts), before its curve is fitted, and the examples' vectors in its order.

    Examples without a term only count for the shares.
    """
    label = np.array([x[1] for x in examples], np.float64)
    empty = np.array([not x[2] for x in examples], bool)
    base = (label.sum() + 0.5) / (len(label) + 1) if len(label) else 0.0
    blank = (label[empty].sum() + base) / (empty.sum() + 1) if len(label) else 0.0
    held = [(i, y, t, c, np.frombuffer(t, np.int32), weights(idf, t, c)) for i, y, t, c in examples if t]
    held.sort(key=lambda x: (x[4][np.argsort(-x[5], kind="stable")[:4]].tolist(), x[0]))  # by the heaviest terms: alike ones meet
    blocks = -(-len(held) // BLOCK)
    tops, start, terms, posts = np.zeros((len(idf), blocks)), [0], [], []
    for b in range(blocks):
        dense = np.zeros((len(idf), BLOCK))
        for place, x in enumerate(held[b * BLOCK : (b + 1) * BLOCK]):
            dense[x[4], place] = x[5]
        tops[:, b] = dense.max(axis=1)
        present = np.flatnonzero(tops[:, b])
        start.append(start[-1] + len(present))
        terms.append(present)
        posts.append(dense[present])
    index = Index(
        idf, np.array([x[1] for x in held], np.float64), np.array([x[0] for x in held], np.int64), tops, np.array(start),
        np.concatenate([np.zeros(0, np.int64), *terms]), np.concatenate([np.zeros((0, BLOCK)), *posts]), float(base), float(blank), 1.0, 0.0,
    )
    return index, [(x[2], x[3]) for x in held]


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and shift of the logistic curve of y over x, with a slight pull to (1, 0)."""
    w = np.array([1.0, 0.0])
    design, pull = np.stack([x, np.ones(len(x))], axis=1), 0.1
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + pull * (w - [1, 0])
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + pull * np.eye(2), gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def stems(word: bytes) -> list[bytes]:
    """The beginnings of a word that is longer than them, marked with a star, which no word holds."""
    text = word.decode("utf-8", "ignore")
    return [text[:n].encode() + b"*" for n in STEMS if len(text) > n]


class Places(dict):
    """Numbers of the terms of a word; filled as words are met."""

    def __init__(self, place: dict[bytes, int]):
        super().__init__()
        self.place = place

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = tuple(self.place[t] for t in (word, *stems(word)) if t in self.place)
        if len(self) >= KNOWN:
            self.clear()
        self[word] = found
        return found


def known_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """doc_id, label (0 or 1) of every id with a label; of several labels of an id the largest counts."""
    rows = labels.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"CAST(`{label_col}` AS INT) AS label")
    return rows.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))


def marking_terms(sample: DataFrame, texts: DataFrame, chance: float = CHANCE, most: int = TERMS, least: int = LEAST) -> list[bytes]:
    """The terms whose presence goes together with the label, by chi-squared with Yates' correction and a level that allows
    for the number of terms tested; strongest first."""
    chosen = texts.join(F.broadcast(sample), "doc_id")  # EXAMPLES rows of two numbers

    def run(batches):
        seen: dict[bytes, list[int]] = {}
        for batch in batches:
            for label, text in zip(batch["label"].to_pylist(), byte_texts(batch), strict=True):
                words = set(terms_of(text))
                for term in words.union(*map(stems, words)):
                    seen.setdefault(term, [0, 0])[label] += 1
            if len(seen) > 500_000:
                yield _seen(seen)
                seen = {}
        yield _seen(seen)

    counted = chosen.select("label", "text").mapInArrow(run, "term binary, clean long, toxic long")
    c, t = (n or 0 for n in sample.agg(F.expr("count_if(label = 0)"), F.expr("count_if(label = 1)")).first())
    cross = f"greatest(abs(toxic * {float(c)}D - clean * {float(t)}D) - {(c + t) / 2}D, 0D)"
    margins = f"((toxic + clean) * ({float(c + t)}D - toxic - clean) * {float(c)}D * {float(t)}D)"
    ranked = counted.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(f"clean + toxic >= {least}")
    ranked = ranked.select("term", F.expr(f"{float(c + t)}D * {cross} * {cross} / nullif({margins}, 0D)").alias("chi")).checkpoint()
    level = NormalDist().inv_cdf(1 - chance / max(1, ranked.count()) / 2) ** 2
    return [bytes(r["term"]) for r in ranked.where(F.col("chi") >= level).orderBy(F.col("chi").desc(), "term").limit(most).collect()]


def _seen(seen: dict[bytes, list[int]]) -> pa.RecordBatch:
    clean, toxic = ([n[i] for n in seen.values()] for i in (0, 1))
    arrays = [pa.array(list(seen), pa.binary()), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["term", "clean", "toxic"])


def vectors(texts: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, terms, counts (arrays as bytes) of every row: which of the terms it holds, and how often."""
    place = {t: i for i, t in enumerate(sorted(terms))}

    def run(batches):
        places = Places(place)
        for batch in batches:
            out: list[list[bytes]] = [[], []]
            for text in byte_texts(batch):
                held = np.fromiter(chain.from_iterable(map(places.__getitem__, terms_of(text))), np.int32)
                for column, x in zip(out, np.unique(held, return_counts=True), strict=True):
                    column.append(x.astype(np.int32).tobytes())
            arrays = [batch["doc_id"], *[pa.array(c, pa.binary()) for c in out]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "terms", "counts"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, terms binary, counts binary")


def rarity(rows: DataFrame, terms: int) -> np.ndarray:
    """ln((1 + N) / (1 + df)) + 1 of every term over all rows."""

    def run(batches):
        held, number = np.zeros(terms, np.int64), 0
        for batch in batches:
            number += batch.num_rows
            held += np.bincount(np.frombuffer(b"".join(batch["terms"].to_pylist()), np.int32), minlength=terms)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(terms)]), pa.array([number, *held.tolist()])], names=["term", "n"])

    table = rows.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in table.collect()}  # one row for each term
    held = np.array([found.get(i, 0) for i in range(terms)], np.float64)
    return np.log((1 + found.get(-1, 0)) / (1 + held)) + 1


def fit(docs: DataFrame, rows: DataFrame, sample: DataFrame, terms: int) -> Index:
    """The index of the sampled rows and its curve; ``rows`` are the vectors of all documents."""
    idf = rarity(rows, terms)
    # the rows of an id differ only if its texts do; one of them is the example
    chosen = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("terms", "counts")).alias("of"))
    examples = [
        (r["doc_id"], r["label"], bytes(r["of"]["terms"]), bytes(r["of"]["counts"])) for r in chosen.orderBy("doc_id").collect()
    ]  # EXAMPLES rows at most
    index, held = build(examples, idf)
    if len(set(index.label.tolist())) < 2:
        return index
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((index, held))

    def left_out(batches):
        index, held = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                own = batch["id"].to_numpy()[start : start + AT_ONCE]
                votes = index.votes(*index.nearest(index.rows([held[i] for i in own]), but=own))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(votes)], names=["id", "vote"])

    numbers = spark.range(0, len(index.label), 1, spark.sparkContext.defaultParallelism)
    judged = numbers.mapInArrow(left_out, "id long, vote double").collect()  # EXAMPLES rows at most
    votes = np.array([r["vote"] for r in sorted(judged, key=lambda r: r["id"])])
    slope, shift = logistic(_odds(votes), index.label)
    return replace(index, slope=slope, shift=shift)


def judge(rows: DataFrame, index: Index) -> DataFrame:
    """score, predicted, and evidence (the nearest examples with label and similarity, nearest first) of every vector."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                vectors = list(zip(part["terms"].to_pylist(), part["counts"].to_pylist(), strict=True))
                different = {v: i for i, v in enumerate(dict.fromkeys(v for v in vectors if v[0]))}
                number, near = index.nearest(index.rows(list(different)))
                scores = np.append(index.probability(index.votes(number, near)), index.blank)
                scores[:-1][(number < 0).all(axis=1)] = index.blank
                own = np.array([different.get(v, len(different)) for v in vectors], np.int64)
                number, near = (np.concatenate([x, np.full((1, NEAREST), -1, np.int64)])[own] for x in (number, near))
                found = number >= 0
                why = pa.StructArray.from_arrays(
                    [
                        pa.array(index.ids[number[found]]), pa.array(index.label[number[found]].astype(np.int32)),
                        pa.array(near[found] / SCALE**2),
                    ],
                    names=["doc_id", "label", "similarity"],
                )
                ends = np.concatenate([[0], np.cumsum(found.sum(axis=1))]).astype(np.int32)
                scores = scores[own]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), why)],
                    names=["doc_id", "score", "predicted", "evidence"],
                )

    evidence = "evidence array<struct<doc_id: long, label: int, similarity: double>>"
    return rows.mapInArrow(run, f"doc_id long, score double, predicted int, {evidence}")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, examples: int = EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every row; only the text bears on a score.

    Labels are learnt from ids whose CRC-32, modulo ``folds``, is not 0; if there are more than ``examples``, those with the
    smallest hashes of their ids. Null and empty texts, and texts without any marking term, get the share of toxic ones among such
    examples. Without any labelled row every score is 0. Rows that share an id are scored each; rows without an id are
    scored and are not held out. Empty tables give an empty result; further columns are not looked at.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    texts = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text")
    known = known_labels(labels).where(crc_mod("doc_id", folds) != 0).join(texts.select("doc_id"), "doc_id", "left_semi")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples).checkpoint()
    terms = marking_terms(sample, texts)
    rows = vectors(texts, terms).checkpoint()  # read to count, to learn, and to judge
    scored = judge(rows, fit(docs, rows, sample, len(terms)))
    held_out = F.coalesce(crc_mod("doc_id", folds) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")
