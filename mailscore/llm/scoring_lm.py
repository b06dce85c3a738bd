"""Log-probabilities of whole texts under a deleted-interpolation bigram model.

P(w | v) = a2 * c(v, w) / c(v) + a1 * c(w) / N + a0 / (V + 1), with three weights for every frequency class of the
context v. The weights are learned by expectation-maximisation on held-out counts: a fold of the training documents,
judged by the counts of the other training documents.

Documents are packed into blocks (compressed, written once to the shared folder). A block sends every distinct unigram
and bigram it holds, as sorted 64-bit hashes with its own count, to the bucket of the hash range; the bucket sums the
blocks' counts and answers with the totals in the order in which it was asked. So a frequent word costs one entry for
each block, wherever it stands, and no table of the vocabulary is held in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscore.llm.blocks import byte_texts, hash_words, mix, slices
from mailscore.session import ensure_checkpoint_dir

BLOCK_BYTES = 8_000_000  # of text in a block; a longer text is a block by itself
STEP = 8  # steps of the quantised probability ratios in a doubling
ZERO = -(1 << 20)  # stands for the logarithm of 0
START, END = np.uint64(0x51A7), np.uint64(0xE17D)  # hashes of the two ends of a text
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack_numbers(values: np.ndarray) -> bytes:
    """64-bit numbers, byte plane after byte plane, compressed; small ones take little room."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_numbers(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.uint64)


BLOCKS = "block long, fold boolean, ids array<long>, train array<boolean>, ends array<long>, texts binary"


def blocks(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """Documents (doc_id, text, train, fold) in blocks, those of the fold in blocks of their own."""

    def run(batches):
        held: dict[bool, list] = {False: [], True: []}
        room = {False: 0, True: 0}

        def out(fold):
            rows, held[fold], room[fold] = held[fold], [], 0
            texts = zstandard.ZstdCompressor(level=3).compress(b"".join(r[2] for r in rows))
            return pa.RecordBatch.from_pylist(
                [{"fold": fold, "ids": [r[0] for r in rows], "train": [r[1] for r in rows], "ends": np.cumsum([len(r[2]) for r in rows]).tolist(), "texts": texts}],
                pa.schema([("fold", pa.bool_()), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("ends", pa.list_(pa.int64())), ("texts", pa.binary())]),
            )

        for batch in slices(batches):
            for doc, train, fold, text in zip(batch["doc_id"].to_pylist(), batch["train"].to_pylist(), batch["fold"].to_pylist(), byte_texts(batch), strict=True):
                if held[fold] and room[fold] + len(text) > size:
                    yield out(fold)
                held[fold].append((doc, train, text))
                room[fold] += len(text)
        for fold, rows in held.items():
            if rows:
                yield out(fold)

    packed = docs.select("doc_id", "train", "fold", "text").mapInArrow(run, BLOCKS.split(", ", 1)[1])
    return packed.select(F.monotonically_increasing_id().alias("block"), "*").checkpoint()


@dataclass
class Tokens:
    """The tokens of a block: hashes of words and of word pairs in order, the words before them, and where texts end."""

    words: np.ndarray
    pairs: np.ndarray
    before: np.ndarray
    ends: np.ndarray
    train: np.ndarray  # of every token


def tokens(row: dict) -> Tokens:
    texts = zstandard.ZstdDecompressor().decompress(row["texts"]) if row["texts"] else b""
    cuts = [0, *row["ends"]]
    parts = [texts[a:b].lower().split() for a, b in zip(cuts, cuts[1:], strict=False)]
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
    words = np.full(int(ends[-1]), END, np.uint64)
    inner = np.ones(len(words), bool)
    inner[ends - 1] = False
    words[inner] = hash_words([w for p in parts for w in p])
    before = np.concatenate([[START], words[:-1]]).astype(np.uint64)
    before[ends[:-1]] = START
    train = np.repeat(np.array(row["train"], bool), np.diff(np.concatenate([[0], ends])))
    return Tokens(words, mix(mix(before, 2) ^ words, 3), before, ends, train)


def keys(block: Tokens) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per kind (words, with the two ends; pairs): sorted distinct keys, the block's training counts, place of every token."""
    out = []
    for values in (block.words, block.pairs):
        distinct, place = np.unique(values, return_inverse=True)
        out.append((distinct, np.bincount(place, weights=block.train, minlength=len(distinct)).astype(np.int64), place))
    return out


def _cuts(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the hash ranges of the buckets begin in sorted keys."""
    edges = [(b << 64) // buckets for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(sorted_keys, np.array(edges, np.uint64)), [len(sorted_keys)]]).astype(np.int64)


def asked(packed: DataFrame, buckets: int) -> DataFrame:
    """block, kind, bucket, fold, keys, counts: what every block asks every bucket."""

    def run(batches):
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            for kind, (distinct, count, _) in enumerate(keys(tokens(row))):
                cut = _cuts(distinct, buckets)
                rows = []
                for b in range(buckets):
                    part = slice(cut[b], cut[b + 1])
                    steps = np.diff(distinct[part], prepend=np.uint64(0))
                    rows.append((row["block"], kind, b, row["fold"], pack_numbers(steps), pack_numbers(count[part])))
                types = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
                names = ["block", "kind", "bucket", "fold", "keys", "counts"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return packed.mapInArrow(run, "block long, kind int, bucket int, fold boolean, keys binary, counts binary")


ANSWER = "block long, kind int, bucket int, total binary, kept binary, tokens long, types long, kept_tokens long, kept_types long"


def answered(questions: DataFrame) -> DataFrame:
    """Totals over all training documents, and over those outside the fold, for every key in the order of the question.

    The first answer of a bucket carries its sums over distinct keys. A bucket is a range of hashes: its size depends on
    the number of distinct keys, not on how often they occur.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [np.cumsum(unpack_numbers(r["keys"]), dtype=np.uint64) for r in rows]
        counts = [unpack_numbers(r["counts"]).astype(np.int64) for r in rows]
        distinct, place = np.unique(np.concatenate(parts), return_inverse=True)
        outside = np.repeat([not r["fold"] for r in rows], [len(p) for p in parts])
        flat = np.concatenate(counts)
        total = np.bincount(place, weights=flat, minlength=len(distinct)).astype(np.int64)
        kept = np.bincount(place, weights=flat * outside, minlength=len(distinct)).astype(np.int64)
        sums = [int(total.sum()), int((total > 0).sum()), int(kept.sum()), int((kept > 0).sum())]
        out, at = [], 0
        for r, p in zip(rows, parts, strict=True):
            mine = place[at : at + len(p)]
            at += len(p)
            out.append((r["block"], r["kind"], r["bucket"], pack_numbers(total[mine]), pack_numbers(kept[mine]), *sums))
            sums = [0, 0, 0, 0]
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4)
        names = [c.split()[0] for c in ANSWER.split(", ")]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return questions.groupBy("kind", "bucket").applyInArrow(run, ANSWER)


@dataclass(frozen=True)
class Sums:
    """Tokens, types and texts that the counts come from."""

    tokens: int
    types: int
    texts: int


def probabilities(block: Tokens, row: dict, which: str, sums: Sums):
    """Count of every token and of the word before it, and the maximum-likelihood estimates of order 2 and 1."""
    count = []
    for kind, (distinct, _, place) in enumerate(keys(block)):
        parts = sorted((a["bucket"], a[which]) for a in row["answers"] if a["kind"] == kind)
        whole = np.concatenate([unpack_numbers(p) for _, p in parts]).astype(np.int64)
        count.append(whole[place] if len(whole) == len(distinct) else None)
    word, pair = count
    context = np.empty(len(word), np.int64)
    context[1:] = word[:-1]
    first = np.concatenate([[0], block.ends[:-1]])
    context[first] = sums.texts
    two = np.divide(pair, context, out=np.zeros(len(word)), where=context > 0)
    one = word / sums.tokens if sums.tokens else np.zeros(len(word))
    return word, context, two, one


def frequency_class(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the whole part of the binary logarithm of its count."""
    return np.where(context > 0, np.frexp(context.astype(float))[1], 0)


def learn(cells: list[tuple[int, int, int, int]], rounds: int = 100) -> np.ndarray:
    """Weights (order 2, 1, 0) of 65 frequency classes from held-out counts.

    A cell is (class, logarithms of P2 / P0 and P1 / P0 in 1 / STEP of a doubling, count); the number of cells is bounded
    by the ranges of the three, whatever the size of the corpus. A class without a held-out token takes the weights
    learned on all of them.
    """
    table = np.array(cells, np.int64).reshape(-1, 4)

    def ratio(x):
        return np.where(x == ZERO, 0.0, np.exp2(np.maximum(x, -(1 << 16)) / STEP))

    p = np.stack([ratio(table[:, 1]), ratio(table[:, 2]), np.ones(len(table))], axis=1)

    def fit(some: np.ndarray) -> np.ndarray:
        weights, n = np.full(3, 1 / 3), table[some, 3][:, None]
        for _ in range(rounds):
            share = p[some] * weights
            share /= share.sum(axis=1, keepdims=True)
            weights = (share * n).sum(axis=0) / n.sum()
        return np.maximum(weights, 1e-9) / np.maximum(weights, 1e-9).sum()

    everything = fit(np.arange(len(table))) if len(table) else np.array([0.0, 0.0, 1.0])
    out = np.tile(everything, (65, 1))
    for k in np.unique(table[:, 0]):
        out[k] = fit(np.flatnonzero(table[:, 0] == k))
    return out


def held_out_cells(with_answers: DataFrame, sums: Sums) -> DataFrame:
    """Held-out counts of the fold, by frequency class and quantised probabilities."""

    def level(p):
        scaled = p * (sums.types + 1)
        return np.where(p > 0, np.round(STEP * np.log2(np.where(p > 0, scaled, 1.0))), ZERO).astype(np.int64)

    def run(batches):
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            _, context, two, one = probabilities(tokens(row), row, "kept", sums)
            cells, n = np.unique(np.stack([frequency_class(context), level(two), level(one)], axis=1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(cells[:, i]) for i in range(3)), pa.array(n)], names=["k", "two", "one", "n"])

    found = with_answers.mapInArrow(run, "k long, two long, one long, n long")
    return found.groupBy("k", "two", "one").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, train, fold, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """Scores every row. ``train`` marks the rows to learn from, ``fold`` those of them that the weights are learned on.

    Texts are lower-cased (ASCII), split at ASCII white space and closed by an end token. Null texts are empty: their one
    token is the end. Rows without an id are scored, but belong to neither set of rows. With nothing to learn from, every
    token has probability 1 / (V + 1) = 1. Repeated rows count as often as they occur; other columns are ignored.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    train = F.coalesce(train, F.lit(False))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), train.alias("train"), (train & F.coalesce(fold, F.lit(False))).alias("fold")
    )
    packed = blocks(rows, size)
    n = packed.agg(F.count("*"), F.sum(F.size("ids")), F.sum(F.size(F.filter("train", lambda t: t))), F.sum(F.when(F.col("fold"), F.size("ids")))).first()
    buckets, texts, texts_fold = max(1, (n[0] or 0) // 2), n[2] or 0, n[3] or 0
    answers = answered(asked(packed, buckets)).checkpoint()
    stats = answers.where("kind = 0").agg(*(F.sum(c) for c in ("tokens", "types", "kept_tokens", "kept_types"))).first()
    whole = Sums(stats[0] or 0, stats[1] or 0, texts)
    kept = Sums(stats[2] or 0, stats[3] or 0, texts - texts_fold)

    def joined(some: DataFrame, which: str) -> DataFrame:
        of = answers.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", which)).alias("answers"))
        return some.join(of, "block")

    cells = held_out_cells(joined(packed.where("fold"), "kept"), kept)
    weights = learn([tuple(r) for r in cells.collect()])  # bounded by the ranges of the cells

    def run(batches):
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            block = tokens(row)
            word, context, two, one = probabilities(block, row, "total", whole)
            a = weights[frequency_class(context)]
            logs = np.log10(a[:, 0] * two + a[:, 1] * one + a[:, 2] / (whole.types + 1))
            base = np.log10((word + 1) / (whole.tokens + whole.types + 1))
            starts = np.concatenate([[0], block.ends[:-1]])
            train = np.array(row["train"], bool)
            m = len(train)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["ids"], pa.int64()),
                    pa.array([not t and d is not None for t, d in zip(row["train"], row["ids"], strict=True)], pa.bool_()),
                    pa.array(np.diff(np.concatenate([[0], block.ends]))),
                    pa.array(np.add.reduceat((word > 0).astype(np.int64), starts)),
                    pa.array(np.full(m, whole.tokens)),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(np.add.reduceat(logs, starts)),
                ],
                names=[c.split()[0] for c in RESULT.split(", ")],
            )

    return joined(packed, "total").mapInArrow(run, RESULT)
