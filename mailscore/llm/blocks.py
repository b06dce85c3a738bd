"""Helpers that the operators share: whole texts as byte strings, words, word hashes, results as Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 500  # rows of an Arrow batch, and rows that are worked on at once
BYTES = 8 << 20  # of a batch of rows that are sent to a Python worker; a single longer text is a batch of its own


def importable(spark) -> None:
    """Prepares the session for Python workers on whole texts.

    They import the package from where the driver has it (on a cluster it is installed or sent along with --py-files),
    get texts in batches of ROWS rows and about BYTES bytes, as a batch of the default size may hold a gigabyte of long
    texts, and give memory back when a batch is done.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name, value in (("PYTHONPATH", root), ("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_ARENA_MAX", "2"), ("MALLOC_TRIM_THRESHOLD_", "1000000")):
        spark.sparkContext.environment.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))


def documents(spark, sf_dir: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a bounded number of rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 4000, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together, or cut, to about so many rows or bytes, for work that gains from many rows at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for part in slices([batch], max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))):
            held.append(part)
            if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
                whole, held = pa.concat_batches(held), []
                yield whole
    if held:
        yield pa.concat_batches(held)


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as UTF-8 byte strings, null as empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    return [t or b"" for t in column.to_pylist()]


# Letters A to Z lower-cased, digits and everything beyond ASCII kept, any other character a blank.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The runs of letters, digits and characters beyond ASCII; only A to Z are lower-cased."""
    return text.translate(_TERMS).split()


def hash_words(words: list[bytes], seed: int = 0) -> np.ndarray:
    """64-bit hash of every word."""
    if seed:
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(values: np.ndarray, salt: int) -> np.ndarray:
    """A bijective scramble of 64-bit values, another one for every salt."""
    with np.errstate(over="ignore"):
        x = values ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def crc_mod(column: str, mod: int):
    """Remainder of the CRC-32 of an id as text; null where the id is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every run of n neighbouring hashes."""
    out = hashes[: max(0, len(hashes) - n + 1)].copy()
    for i in range(n):
        out = mix(out ^ hashes[i : i + len(out)] if i else out, n)
    return out


def flat_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts in one list, and where each text ends in it; split at ASCII white space."""
    parts = [t.split() for t in texts]
    return [w for p in parts for w in p], np.cumsum([len(p) for p in parts], dtype=np.int64)
