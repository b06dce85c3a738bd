"""Removal of passages of many words that an earlier document holds, by super-k-mers.

The minimiser of a window is the smallest hash among its runs of RUN words. Neighbouring windows that share it form a
super-k-mer, which travels as one packed string to the bucket of the minimiser; there the windows are sorted and equal
ones found. Equal windows have equal minimisers, so a super-k-mer whose minimiser no other document has is never sent.
A minimiser with many windows is dealt out over several buckets by document; what is left of each after sorting (one
line for a distinct window) is compared across them in a second step.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscore.llm.blocks import byte_texts, flat_words, hash_words, ngram_hashes, slices
from mailscore.session import ensure_checkpoint_dir

WINDOW = 50
RUN = 8
BUCKET = 50_000  # windows that are sorted together
LONGEST = 10_000  # windows of a super-k-mer; longer runs are cut

SPANS = "doc_id long, version long, minimiser long, first int, n int"
PACKED = "minimiser long, salt long, salts long, doc_id long, version long, first int, n int, words binary"
FOUND = "doc_id long, version long, first int, n int, h1 long, h2 long"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def super_kmers(texts: list[bytes], window: int = WINDOW, run: int = RUN):
    """(text, first window, windows, minimiser) of every super-k-mer, as arrays."""
    words, ends = flat_words(texts)
    low = sliding_min(ngram_hashes(hash_words(words), run), window - run + 1)
    start = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    at = np.arange(len(low))
    text = np.searchsorted(ends, at, side="right")
    whole = at + window <= ends[text] if len(low) else np.zeros(0, bool)
    at, text, low = at[whole], text[whole], low[whole].view(np.int64)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    inside = at - start[text]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(new)
    new[at - at[heads][np.cumsum(new) - 1] >= LONGEST] = False  # cut below
    sizes = np.diff(np.concatenate([heads, [len(at)]]))
    reps = -(-sizes // LONGEST)
    part = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    head = np.repeat(heads, reps) + part * LONGEST
    size = np.minimum(np.repeat(sizes, reps) - part * LONGEST, LONGEST)
    return text[head], inside[head], size, low[head]


def _spans(window: int, run: int):
    def work(batches):
        for batch in slices(batches):
            text, first, n, low = super_kmers(byte_texts(batch), window, run)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text)), batch.column(1).take(pa.array(text)), pa.array(low), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["doc_id", "version", "minimiser", "first", "n"],
            )

    return work


def _pack(window: int):
    """The words of every span, as one string."""

    def work(batches):
        for batch in slices(batches, 200):
            out: list[list] = [[] for _ in range(8)]
            for doc, version, spans, text in zip(batch["doc_id"].to_pylist(), batch["version"].to_pylist(), batch["spans"].to_pylist(), byte_texts(batch), strict=True):
                words = text.split()
                for s in spans:
                    packed = b" ".join(words[s["first"] : s["first"] + s["n"] + window - 1])
                    for column, x in zip(out, (s["minimiser"], s["salt"], s["salts"], doc, version, s["first"], s["n"], packed), strict=True):
                        column.append(x)
            types = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.binary()]
            names = ["minimiser", "salt", "salts", "doc_id", "version", "first", "n", "words"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return work


def _later(group: list[tuple], window: int):
    """Of the super-k-mers of a bucket (doc, version, first, words): spans of windows that a smaller document has, and,
    one for a distinct window and document, the windows that none has."""
    lines = []
    for k, (doc, _, _, words) in enumerate(group):
        cuts = np.concatenate([[-1], np.flatnonzero(np.frombuffer(words, np.uint8) == 32), [len(words)]]).tolist()
        lines += [(words[cuts[i] + 1 : cuts[i + window]], doc, k, i) for i in range(len(cuts) - window)]
    lines.sort()
    flagged: dict[int, list[int]] = {}
    firsts, text, owner = [], None, 0
    for line in lines:
        if line[0] != text:
            text, owner = line[0], line[1]
        if line[1] > owner:
            flagged.setdefault(line[2], []).append(line[3])
        else:
            firsts.append(line)
    spans = []
    for k, places in flagged.items():
        doc, version, first, _ = group[k]
        places = np.sort(np.array(places))
        breaks = np.concatenate([[0], np.flatnonzero(np.diff(places) > 1) + 1, [len(places)]])
        spans += [(doc, version, first + int(places[a]), int(b - a)) for a, b in zip(breaks[:-1], breaks[1:], strict=True)]
    return spans, firsts


def _compare(window: int):
    """Works on rows sorted by bucket, one bucket after another."""

    def emit(key, group):
        out: list[tuple] = []
        if len({g[0] for g in group}) > 1 or key[2] > 1:
            spans, firsts = _later(group, window)
            out = [(*s, None, None) for s in spans]
            if key[2] > 1:
                for words, doc, k, i in firsts:
                    h = xxhash.xxh3_128_digest(words)
                    a, b = np.frombuffer(h, np.int64).tolist()
                    out.append((doc, group[k][1], group[k][2] + i, 1, a, b))
        return out

    def batch_of(rows):
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "version", "first", "n", "h1", "h2"])

    def work(batches):
        key, group, out = None, [], []
        for batch in batches:
            for *k, doc, version, first, _, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if group:
                        out += emit(key, group)
                    key, group = k, []
                group.append((doc, version, first, words))
                if len(out) > 50_000:
                    yield batch_of(out)
                    out = []
        if group:
            out += emit(key, group)
        yield batch_of(out)

    return work


def repeated(texts: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """doc_id, version, first, n: runs of n windows from ``first`` on that also start in a document with a smaller id."""
    spans = texts.mapInArrow(_spans(window, run), SPANS)
    shared = spans.groupBy("minimiser").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("n").alias("windows")).where("lo < hi")
    salts = F.ceil(F.col("windows") / BUCKET).cast("long")
    sent = spans.join(shared.select("minimiser", salts.alias("salts")), "minimiser").withColumn("salt", F.pmod(F.xxhash64("doc_id", "first"), F.col("salts")))
    by_text = sent.groupBy("doc_id", "version").agg(F.collect_set(F.struct("minimiser", "salt", "salts", "first", "n")).alias("spans"))
    packed = texts.join(by_text, ["doc_id", "version"]).select("doc_id", "version", "spans", "text").mapInArrow(_pack(window), PACKED)
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = packed.repartition(n, "minimiser", "salt").sortWithinPartitions("minimiser", "salt").mapInArrow(_compare(window), FOUND)
    return found


def across(found: DataFrame) -> DataFrame:
    """Adds the comparison between the buckets of one minimiser."""
    left = found.where("h1 IS NOT NULL")
    owner = left.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
    more = left.join(owner, ["h1", "h2"]).where("doc_id > owner")
    return found.where("h1 IS NULL").select("doc_id", "version", "first", "n").unionAll(more.select("doc_id", "version", "first", "n"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept words of every row.

    Words go that lie in a window whose words also start in a document with a smaller id, judged on the texts as given.
    Null and empty texts have no words; a row without an id loses nothing and takes nothing; rows that share an id don't
    take from each other; ``version`` tells apart rows of one id with different texts.
    """
    texts = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"xxhash64(`{text_col}`) AS version", f"`{text_col}` AS text")
    named = texts.where("doc_id IS NOT NULL AND text IS NOT NULL")
    ensure_checkpoint_dir(docs.sparkSession)
    runs = across(repeated(named, window, run).checkpoint()).groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "n")).alias("runs"))

    def cut(batches):
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            for text, spans in zip(byte_texts(batch), batch["runs"].to_pylist(), strict=True):
                words, gone = text.split(), None
                if spans:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        gone[s["first"]] += 1
                        gone[min(s["first"] + s["n"] + window - 1, len(words))] -= 1
                    keep = np.cumsum(gone)[:-1] <= 0
                    left = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                else:
                    left = words
                kept = b" ".join(left)
                for column, x in zip(out, (len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(x)
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *arrays], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return texts.join(runs, ["doc_id", "version"], "left").select("doc_id", "runs", "text").mapInArrow(cut, RESULT)
