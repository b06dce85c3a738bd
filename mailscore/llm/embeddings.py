"""Near-duplicate vectors: binary codes by iterative quantisation, multi-index Hamming tables, rerank by cosine.

A rotation that makes the bits of the codes balanced and close to the vectors is learned on a bounded sample. The code of
a vector is cut into four chunks of 16 bits; a vector is kept under its own value of every chunk and looked up under the
values that differ in one bit at most. Two codes that differ in 7 bits or fewer are thus sure to meet, and most that
differ in more. Where they meet the vectors themselves are compared, in the first of the tables that has them together,
so that a link is counted once. A crowded bucket is cut into blocks that are compared block by block; what a block
returns is a count for each vector and a star for each of its connected parts, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscore.llm.components import components
from mailscore.session import ensure_checkpoint_dir

SAMPLE = 20_000  # vectors that the rotation is learned on, those with the smallest hashes of their ids
BITS, CHUNK = 64, 16
TABLES = BITS // CHUNK
ROUNDS = 50
BLOCK = 2_000  # vectors on either side of a comparison
CODED = "vec_id long, space long, code long, vector binary"
FOUND = "vec_id long, n long, root long"


def itq(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits): principal directions, rotated so that signs lose least.

    Needs as many directions as bits; vectors of fewer dimensions get random ones besides.
    """
    draw = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, _, directions = np.linalg.svd(centred, full_matrices=False)
    base = directions[:bits].T
    if base.shape[1] < bits:
        base = np.concatenate([base, draw.normal(size=(len(mean), bits - base.shape[1])) / np.sqrt(len(mean))], axis=1)
    flat = centred @ base
    turn = np.linalg.qr(draw.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        codes = np.where(flat @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ flat)
        turn = (left @ right).T
    return mean, base @ turn


def usable(docs: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, vector of the rows that can link: no null, no non-finite component, not zero."""
    rows = docs.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce((x == x) & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False)))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(finite & F.exists("vector", lambda x: x != 0))


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # keeps the squares in range
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def coded(rows: DataFrame, models: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """vec_id, space (what may be compared: label and dimensions), code, unit vector as bytes."""

    def run(batches):
        for batch in batches:
            vectors = batch["vector"].to_pylist()
            codes, units = [], []
            for v in vectors:
                u = unit(np.array([v]))
                mean, turn = models[len(v)]
                bits = ((u - mean) @ turn >= 0)[0]
                codes.append(int(np.packbits(bits).view(">i8")[0]))
                units.append(u.tobytes())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["space"], pa.array(codes, pa.int64()), pa.array(units, pa.binary())], names=["vec_id", "space", "code", "vector"])

    space = F.xxhash64("label", F.size("vector")).alias("space")
    return rows.select("vec_id", space, "vector").mapInArrow(run, CODED)


def chunks(code):
    """The chunks of a code column."""
    return [F.shiftrightunsigned(code, CHUNK * t).bitwiseAND((1 << CHUNK) - 1).cast("int") for t in range(TABLES)]


def compared(cosine: float):
    """Compares the vectors kept in a bucket with those looked up there, for rows sorted by bucket and block."""

    def links(kept, asked, table):
        (home_id, home_code), (ask_id, ask_code) = ([np.array([r[k] for r in side], np.int64) for k in (0, 1)] for side in (kept, asked))
        home = np.stack([np.frombuffer(r[2]) for r in kept])
        ask = np.stack([np.frombuffer(r[2]) for r in asked])
        near = (ask @ home.T >= cosine - 1e-9) & (ask_id[:, None] != home_id[None, :])
        a, b = np.nonzero(near)
        exact = np.einsum("ij,ij->i", ask[a], home[b]) >= cosine
        differ = (ask_code[a] ^ home_code[b]).view(np.uint64)
        for t in range(table):  # an earlier table has the pair already
            part = ((differ >> np.uint64(CHUNK * t)) & np.uint64((1 << CHUNK) - 1)).astype(np.int64)
            exact &= (part & (part - 1)) != 0
        return ask_id[a[exact]], home_id[b[exact]], b[exact]

    def emit(key, kept, asked):
        if not kept or not asked:
            return []
        x, y, at = links(kept, asked, key[1])
        if not len(x):
            return []
        times = np.array([r[3] for r in kept], np.int64)[at]
        nodes, place = np.unique(np.concatenate([x, y]), return_inverse=True)
        a, b = place[: len(x)], place[len(x) :]
        root = np.arange(len(nodes))
        while True:  # smallest node of every connected part of the block
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            low = low[low]
            if (low == root).all():
                break
            root = low
        n = np.bincount(a, weights=times, minlength=len(nodes)).astype(np.int64)
        return list(zip(nodes.tolist(), n.tolist(), nodes[root].tolist(), strict=True))

    def batch_of(rows):
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["vec_id", "n", "root"])

    def run(batches: Iterator[pa.RecordBatch]):
        key, kept, asked, out = None, [], [], []
        for batch in batches:
            for *k, home, vec, code, copies, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    out += emit(key, kept, asked) if key else []
                    key, kept, asked = k, [], []
                    if len(out) > 50_000:
                        yield batch_of(out)
                        out = []
                (kept if home else asked).append((vec, code, vector, copies))
        out += emit(key, kept, asked) if key else []
        yield batch_of(out)

    return run


def near_vectors(docs: DataFrame, cosine: float = 0.98, sample: int = SAMPLE, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; only vectors of one label and length are compared.

    A vector that is null, zero or holds a null or non-finite component, or has no label or id, links with nothing. Rows
    of one id and different vectors count as one; a row repeated whole links with nothing of its own id.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    good = usable(docs, id_col, vector_col, label_col).checkpoint()
    models = {}
    for r in good.select(F.size("vector").alias("d")).distinct().collect():  # the lengths of vectors, one or a few
        some = good.where(F.size("vector") == r["d"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toPandas()
        models[r["d"]] = itq(unit(np.stack(some["vector"].to_list()).astype(float)))
    same = good.groupBy("label", "vector").agg(F.min("vec_id").alias("vec_id"), F.count_distinct("vec_id").alias("copies"))
    first = coded(same.select("vec_id", "label", "vector"), models).checkpoint()
    # copies by (id, space, code): classes of one id differ in their vector
    rows = first.join(same.groupBy("vec_id").agg(F.max("copies").alias("copies")), "vec_id")
    parts = F.array(*[F.struct(F.lit(t).alias("t"), c.alias("value")) for t, c in enumerate(chunks(F.col("code")))])
    home = rows.select("vec_id", "space", "code", F.inline(parts).alias("t", "value"))
    masks = F.array(F.lit(0), *[F.lit(1 << i) for i in range(CHUNK)])
    crowd = home.groupBy("space", "t", "value").agg(F.count("*").alias("kept"))
    ask = home.withColumn("mask", F.explode(masks)).withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")
    met = ask.join(crowd, ["space", "t", "value"])
    others = met.groupBy("space", "t", "value").agg(F.count("*").alias("asked"), F.max("kept").alias("kept")).where("asked > 1").checkpoint()
    sides = others.withColumn("kept_blocks", F.ceil(F.col("kept") / block).cast("int")).withColumn("asked_blocks", F.ceil(F.col("asked") / block).cast("int"))
    sides = sides.select("space", "t", "value", "kept_blocks", "asked_blocks")
    place = F.xxhash64("vec_id", "code")

    def dealt(some, is_home, own, other):
        mine = F.pmod(place, F.col(own)).cast("int").alias("mine")
        dealt_ = some.join(sides, ["space", "t", "value"]).select("space", "t", "value", "vec_id", "code", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("theirs"))
        k, a = ("mine", "theirs") if is_home else ("theirs", "mine")
        return dealt_.select("space", "t", "value", F.col(k).alias("k"), F.col(a).alias("a"), F.lit(is_home).alias("home"), "vec_id", "code")

    sent = dealt(home, True, "kept_blocks", "asked_blocks").unionAll(dealt(ask, False, "asked_blocks", "kept_blocks"))
    full = sent.join(rows.select("vec_id", "space", "code", "copies", "vector"), ["vec_id", "space", "code"])
    bucket = ["space", "t", "value", "k", "a"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = full.select(*bucket, "home", "vec_id", "code", "copies", "vector").repartition(n, *bucket).sortWithinPartitions(*bucket)
    found = sorted_.mapInArrow(compared(cosine), FOUND).checkpoint()
    return _result(docs, good, same, found, id_col)


def _result(docs: DataFrame, good: DataFrame, same: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """Spreads what the first of equal vectors found over its copies."""
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    member = good.select("label", "vector", F.col("vec_id").alias("id")).distinct().join(same.withColumnRenamed("vec_id", "first"), ["label", "vector"]).select("id", "first", "copies")
    copies = member.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")).unionAll(copies))
    own = member.join(counts.withColumnRenamed("vec_id", "first"), "first", "left").groupBy("id").agg(F.max(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    ids = docs.select(F.col(id_col).cast("long").alias("vec_id"))
    out = ids.join(own.withColumnRenamed("id", "vec_id"), "vec_id", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )
