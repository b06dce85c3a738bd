"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over neighbouring words; words at its zeros do not enter the hash, so a hit survives
substitutions there. Hashes of the benchmark are looked up for every place of every document, a bit table of fixed size
answering for the places that cannot hit. Around a hit the words of item and document are compared along the same
diagonal: a leak is a stretch of at least ``least`` equal words in which a differing word costs as much as two equal ones
gain, or three quarters of an item's words equal in their places. The seeds are chosen so that every way to substitute a
quarter of an item of up to 19 words leaves a hit, and that every stretch of 12 equal words holds one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscore.llm.blocks import byte_texts, hash_words, mix, slices

# fixed values: seeds of weight 5, for items of 12 words or more
MASKS = ("111011", "110100011", "11001011", "110111", "111000010001")
SMALL = ("1111", "11101", "11011", "10111", "1100011")  # weight 4, for shorter items
FEW = 12  # items of fewer words take the seeds of weight 4
LEAST = 12  # equal words of a leak
SHORTEST = 5  # words of the shortest item that is looked for
BLOCK = 1_000_000  # words of the benchmark that are looked up at once
BITS = 22
SCHEMA = "doc_id long, item_id long, doc_word long, item_word long, n_words long, n_equal long"
# upper-case letters become lower-case ones, ASCII marks and control characters blanks
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words under the mask, for every place where it fits."""
    n = len(hashes) - len(mask) + 1
    out = np.zeros(max(0, n), np.uint64)
    if n > 0:
        for i, bit in enumerate(mask):
            if bit == "1":
                out = mix(out ^ hashes[i : i + n], len(mask)) if i else mix(hashes[:n], len(mask))
    return out


@dataclass(frozen=True)
class Index:
    """Seeds of one block of the benchmark: sorted hashes with item and place, and a bit for each hash."""

    items: list[int]
    hashes: list[np.ndarray]
    masks: list[str]
    keys: list[np.ndarray]
    item: list[np.ndarray]
    place: list[np.ndarray]
    seen: list[np.ndarray]


def index(rows: list[tuple[int, bytes]]) -> Index:
    items, hashes = [], []
    for item, text in rows:
        found = hash_words(words(text))
        if len(found) >= SHORTEST:
            items.append(item)
            hashes.append(found)
    out = Index(items, hashes, [*MASKS, *SMALL], [], [], [], [])
    for mask in out.masks:
        use = [i for i, h in enumerate(hashes) if (len(h) < FEW) == (mask in SMALL)]
        keyed = [seeds(hashes[i], mask) for i in use]
        keys = np.concatenate([np.zeros(0, np.uint64), *keyed])
        item = np.repeat(np.array(use, np.int64), [len(x) for x in keyed])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in keyed)])
        order = np.argsort(keys, kind="stable")
        seen = np.zeros(1 << BITS, bool)
        seen[(keys >> np.uint64(64 - BITS)).astype(np.int64)] = True
        for column, x in zip((out.keys, out.item, out.place, out.seen), (keys[order], item[order], place[order], seen), strict=True):
            column.append(x)
    return out


def stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, length and equal words of the best stretch; a differing word costs two equal ones."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end - start, int(equal[start:end].sum())


def leaks(found: Index, texts: list[bytes], least: int = LEAST) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item, first word in document, first word in item, words, equal words) of the best stretch of a pair."""
    parts = [words(t) for t in texts]
    lengths = np.array([len(p) for p in parts], np.int64)
    if not found.items or not lengths.sum():
        return
    flat = hash_words([w for p in parts for w in p])
    ends = np.cumsum(lengths)
    pairs: dict[tuple[int, int], set[int]] = {}
    for mask, keys, item, place, seen in zip(found.masks, found.keys, found.item, found.place, found.seen, strict=True):
        if not len(keys):
            continue
        key = seeds(flat, mask)
        at = np.flatnonzero(seen[(key >> np.uint64(64 - BITS)).astype(np.int64)])
        low, high = np.searchsorted(keys, key[at], "left"), np.searchsorted(keys, key[at], "right")
        at, low, high = at[high > low], low[high > low], high[high > low]
        row = np.searchsorted(ends, at, side="right")
        whole = at + len(mask) <= ends[row]  # not from one document into the next
        for p, r, a, b in zip(at[whole].tolist(), row[whole].tolist(), low[whole].tolist(), high[whole].tolist(), strict=True):
            for k in range(a, b):
                pairs.setdefault((r, int(item[k])), set()).add(p - int(place[k]))
    starts = ends - lengths
    for (r, i), diagonals in pairs.items():
        target, best = found.hashes[i], (0, 0, 0, 0)
        for diagonal in diagonals:
            a, b = max(diagonal, int(starts[r])), min(diagonal + len(target), int(ends[r]))
            same = flat[a:b] == target[a - diagonal : b - diagonal]
            total = int(same.sum())
            if total < least and 4 * total < 3 * len(target):
                continue
            start, n, equal = stretch(same)
            if equal < least:
                if 4 * total < 3 * len(target):
                    continue
                places = np.flatnonzero(same)  # the item as a whole, from its first to its last equal word
                start, n, equal = int(places[0]), int(places[-1] - places[0]) + 1, total
            best = max(best, (equal, -n, -(a + start - int(starts[r])), a - diagonal + start))
        if best[0]:
            yield r, found.items[i], -best[2], best[3], -best[1], best[0]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int = BLOCK) -> list[DataFrame]:
    """The benchmark, a stated set of questions, in blocks of about ``size`` words by hash of the item id."""
    rows = benchmark.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS item_id", f"`{text_col}` AS text").where("item_id IS NOT NULL AND text IS NOT NULL")
    n = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = 1 + n // (5 * size)
    return [rows.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k) if count > 1 else rows for k in range(count)]


def _indexes(docs: DataFrame, benchmark: DataFrame, item_id: str, item_text: str):
    for block in blocks(benchmark, item_id, item_text):
        rows = [(r["item_id"], r["text"].encode()) for r in block.collect()]  # one block of bounded size
        yield docs.sparkSession.sparkContext.broadcast(index(rows))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for every document row and item that share a leak, with the place and size of its longest stretch.

    Letters are compared without ASCII case and ASCII marks. Null or empty texts leak nothing; items under five words are
    not looked for, nor are items without an id or a text; repeated rows give repeated results.
    """
    texts = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text")
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for shared in _indexes(docs, benchmark, item_id, item_text):

        def run(batches, shared=shared):
            for batch in slices(batches):
                ids = batch.column(0).to_pylist()
                rows = [(ids[r], *rest) for r, *rest in leaks(shared.value, byte_texts(batch), least)]
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_equal"])

        out = out.unionAll(texts.mapInArrow(run, SCHEMA))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that share no leak with any item."""
    for shared in _indexes(docs, benchmark, item_id, item_text):

        def run(batches, shared=shared):
            for batch in slices(batches):
                keep = np.ones(batch.num_rows, bool)
                for r, *_ in leaks(shared.value, byte_texts(batch, text_col), least):
                    keep[r] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
