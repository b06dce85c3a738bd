"""Near-duplicate documents by an inverted join over MinHash signatures.

A document is posted under every coordinate-value pair of its signature. A pair of documents is a candidate if it
collides in at least MATCHES of the COORDS coordinates, so
* values that one document alone has are left out, and with them every document with fewer than MATCHES others;
* of a document's n shared values, in one global order from rare to frequent, only the first n - MATCHES + 1 are looked
  up (its prefix): two documents that collide MATCHES times share a value in both prefixes.
Texts with equal shingle sets are one class. Classes are first compared with two neighbours each: of the hubs of their
lists (the class of a list whose values are the most frequent, as those of an original among its copies are), the one
with which they collide most and the one of the most frequent values. A second pass takes the classes that still share a list with *another* component, and joins
them over the rarest of their shingles (again a prefix: what similar sets must have in common), leaving out the pairs
inside the main component of a list. Collisions of these pairs are counted by merging the signatures, skipping a pair as
soon as it cannot reach the threshold, and what is left is confirmed. Groups of copies are thus not expanded into pairs:
pairs inside a component need no comparison, and a heavily edited copy, whose rarest shingles are its own, meets nobody.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailscore.llm.blocks import byte_texts, flat_words, hash_words, ngram_hashes, slices
from mailscore.llm.components import components, release
from mailscore.session import ensure_checkpoint_dir

SHINGLE = 5
COORDS = 64
MATCHES = 34  # at a similarity of 0.75 a pair has 48 collisions on average, and fewer than 34 once in 10,000 times
PERCENT = 75
BROADCAST_IDS = 400_000

_DRAW = np.random.default_rng(20)
ODD = _DRAW.integers(0, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FLIP = _DRAW.integers(0, 2**63, COORDS, dtype=np.uint64)

SKETCH = "doc_id long, n_shingles long, f1 long, f2 long, signature binary"


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word runs of every text (of the whole sequence where it is shorter)."""
    words, ends = flat_words([t.lower() for t in texts])
    hashes = hash_words(words)
    runs = ngram_hashes(hashes, k)
    out, start = [], 0
    for end in ends.tolist():
        n = end - start
        if n >= k:
            out.append(np.unique(runs[start : end - k + 1]))
        else:
            out.append(ngram_hashes(hashes[start:end], n) if n else hashes[:0])
        start = end
    return out


def signature(shingles: np.ndarray) -> bytes:
    """The upper halves of the smallest values of COORDS scrambles."""
    return b"".join(((((shingles ^ f) * o).min()) >> np.uint64(32)).astype("<u4").tobytes() for f, o in zip(FLIP, ODD, strict=True))


def sketches(texts: DataFrame) -> DataFrame:
    """doc_id, n_shingles, f1 and f2 (128 bits that name the set), signature of every row of (doc_id, text)."""

    def run(batches):
        for batch in slices(batches):
            sets = shingle_sets(byte_texts(batch))
            names = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist() for s in sets]
            arrays = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([n[0] for n in names], pa.int64()),
                pa.array([n[1] for n in names], pa.int64()),
                pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_shingles", "f1", "f2", "signature"])

    return texts.mapInArrow(run, SKETCH)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    pairs = pairs.checkpoint()
    wanted = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b"))

    def run(batches):
        for batch in slices(batches):
            sets = [s.tobytes() for s in shingle_sets(byte_texts(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    def compare(batches):
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch["s"].to_pylist(), batch["t"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = wanted_texts(texts, wanted).mapInArrow(run, "doc_id long, shingles binary")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("t")), "b"
    )
    return both.mapInArrow(compare, "a long, b long")


def prefixes(classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """rep, size of its set, weight (how frequent its values are), token: the shared coordinate-value pairs that a class
    has to be looked up under, rare ones first."""

    def post(batches):
        for batch in slices(batches):
            values = np.frombuffer(b"".join(batch["signature"].to_pylist()), "<u4").reshape(-1, COORDS).astype(np.int64)
            token = values | np.arange(COORDS, dtype=np.int64) << 32
            rep = np.repeat(batch["rep"].to_numpy(zero_copy_only=False), COORDS)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(token.ravel())], names=["rep", "token"])

    tokens = classes.select("rep", "signature").mapInArrow(post, "rep long, token long")
    many = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    found = F.array_sort(F.collect_list(F.struct("df", "token"))).alias("of")  # COORDS entries at most
    shared = tokens.join(many, "token").groupBy("rep").agg(found, F.sum("df").alias("weight")).where(F.size("of") >= matches)
    short = shared.select("rep", "weight", F.expr(f"slice(of, 1, size(of) - {matches - 1})").alias("of"))
    sized = short.join(classes.groupBy("rep").agg(F.max("n_shingles").alias("size")), "rep")
    return sized.select("rep", "size", "weight", F.explode("of.token").alias("token"))


def colliding(pairs: DataFrame, classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """The pairs (a, b) that collide in at least ``matches`` coordinates, and in how many."""

    def run(batches):
        for batch in slices(batches):
            x = np.frombuffer(b"".join(batch["x"].to_pylist()), "<u4").reshape(-1, COORDS)
            y = np.frombuffer(b"".join(batch["y"].to_pylist()), "<u4").reshape(-1, COORDS)
            met = np.zeros(len(x), np.int64)
            live = np.arange(len(x))
            for start in range(0, COORDS, 8):  # eight coordinates at a time; pairs that cannot get there any more are skipped
                met[live] += (x[live, start : start + 8] == y[live, start : start + 8]).sum(axis=1)
                live = live[met[live] + COORDS - start - 8 >= matches]
            out = pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(met)], names=["a", "b", "met"])
            yield out.filter(pa.array(met >= matches))

    one = classes.select(F.col("rep").alias("a"), F.col("signature").alias("x"))
    two = classes.select(F.col("rep").alias("b"), F.col("signature").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, met long")


def wanted_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of (doc_id, text) whose ids are wanted."""
    wanted = wanted.distinct().checkpoint()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)  # a few MB at most; beyond it the texts are joined by a shuffle
    return texts.join(wanted, "doc_id", "left_semi")


def apart(open_: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of classes in different components that can be similar enough; ``open_`` has rep and root.

    Sets of n and m shingles that are similar enough have at least ``need`` in common, so one that is among the rarest
    n - need + 1 of the one and among the rarest m - need + 1 of the other. In a list the main component is not looked up, only met by the others.
    """

    def run(batches):
        for batch in slices(batches, 200):
            sets = shingle_sets(byte_texts(batch))
            n = [len(s) for s in sets]
            reps, version = (np.repeat(batch[c].to_numpy(zero_copy_only=False), n) for c in ("doc_id", "version"))
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            arrays = [pa.array(reps), pa.array(version), pa.array(np.repeat(np.array(n, np.int64), n)), pa.array(flat)]
            yield pa.RecordBatch.from_arrays(arrays, names=["rep", "version", "size", "shingle"])

    wanted = wanted_texts(texts, open_.select(F.col("rep").alias("doc_id")))
    once = wanted.select("doc_id", F.xxhash64("text").alias("version"), "text").dropDuplicates(["doc_id", "version"])
    rows = once.mapInArrow(run, "rep long, version long, size long, shingle long")
    many = rows.groupBy("shingle").agg(F.count("*").alias("df"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    own = Window.partitionBy("rep", "version")
    alone = F.col("size") - F.count("*").over(own)  # shingles that no other class has are the rarest
    ranked = rows.join(many.select("shingle", "df"), "shingle").select(
        "rep", "size", "shingle", (alone + F.row_number().over(own.orderBy("df", "shingle"))).alias("place")
    )
    needed = F.ceil(F.col("size") * percent / 100)  # with a set of any size
    posts = ranked.where(F.col("place") <= F.col("size") - needed + 1).join(open_, "rep")
    mains = posts.groupBy("shingle", "root").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max_by("root", "n").alias("main"), F.count("*").alias("roots"))
    posts = posts.join(mains.where("roots > 1"), "shingle").select("shingle", "rep", "size", "place", "root", "main").checkpoint()
    x, y = posts.where("root <> main").alias("x"), posts.alias("y")
    need = F.ceil((F.col("x.size") + F.col("y.size")) * percent / (100 + percent))
    met = x.join(y, F.col("x.shingle") == F.col("y.shingle")).where(
        (F.col("x.root") != F.col("y.root"))
        & ((F.col("y.root") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep")))
        & (F.col("x.place") <= F.col("x.size") - need + 1)
        & (F.col("y.place") <= F.col("y.size") - need + 1)
        & comparable("x.size", "y.size", percent)
    )
    return met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def comparable(a: str, b: str, percent: int = PERCENT):
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def linked(classes: DataFrame, texts: DataFrame, matches: int = MATCHES, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between classes whose components are those of all links."""
    posts = prefixes(classes, matches).checkpoint()
    hubs = posts.groupBy("token").agg(F.max(F.struct("weight", -F.col("rep"), "size")).alias("hub"))
    hub = -F.col("hub.col2")
    met = posts.join(hubs, "token").where((hub != F.col("rep")) & comparable("size", "hub.size", percent))
    near = colliding(met.select(hub.alias("a"), F.col("rep").alias("b")).distinct(), classes, matches)
    near = near.join(posts.select(F.col("rep").alias("a"), "weight").distinct(), "a")
    two = near.groupBy("b").agg(F.max_by("a", "met").alias("one"), F.max_by("a", F.struct("weight", "a")).alias("two"))
    tries = two.select(F.explode(F.array("one", "two")).alias("a"), "b")
    tries = tries.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = confirmed(tries, texts, percent).checkpoint()
    del hubs, met, near, two, tries
    release(first.sparkSession)
    roots = components(first).checkpoint()
    release(first.sparkSession)
    placed = posts.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select(
        "token", "rep", F.coalesce("root", "rep").alias("root")
    )
    split = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
    open_ = placed.join(split, "token").select("rep", "root").distinct().checkpoint()
    second = colliding(apart(open_, texts, percent), classes, matches).select("a", "b")
    both = first.unionAll(confirmed(second, texts, percent)).checkpoint()
    del posts, roots, placed, split, open_, second
    release(both.sparkSession)
    return both


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Rows that share an id are one document. A text without words has an empty set and is linked with nothing; a row
    without an id is linked with nothing, has no component and is kept.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    texts = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text")
    rows = sketches(texts).checkpoint()
    named = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = named.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")).checkpoint()
    members = named.join(classes.select("n_shingles", "f1", "f2", "rep"), ["n_shingles", "f1", "f2"]).where("doc_id <> rep")
    copies = members.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    found = linked(classes, texts.where("doc_id IS NOT NULL"))
    roots = components(found.unionAll(copies))
    out = rows.select("doc_id", "n_shingles").join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
