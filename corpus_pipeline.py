"""The corpus pipeline: which documents stay, what their texts are, and how they are packed for training.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the
columns of ``documents``. Empty tables give empty tables. Rows without an id are kept by every stage that does not judge
their text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailscore.llm import decontaminate, language_id, minhash, packing, surrogates
from mailscore.llm.blocks import importable
from mailscore.session import ensure_checkpoint_dir

KEY = "surrogates of the test tables"  # a real run takes its key from a secret store
SURE = 0.5  # a text whose language is less probable than this is rejected


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter or without a probable language; ``lang`` becomes the language found.

    Where no row has a language to learn from, every text with a letter stays as it is.
    """
    importable(spark)
    model = language_id.fit(language_id.training_rows(docs))
    if not model.langs:
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    lang, prob = surrogates.unused(docs, "lang", "prob")
    found = language_id.predict(docs, model, lang=lang, prob=prob)
    kept = found.where((F.col(lang) != language_id.UNDETERMINED) & (F.col(prob) >= SURE))
    return kept.select(*[F.col(lang).alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of near copies, once.

    Rows that share an id are one document: of differing texts the one with the smallest SHA-256 stays. Rows without an
    id all stay.
    """
    importable(spark)
    groups = minhash.near_duplicates(docs).checkpoint()
    gone = groups.where("NOT kept").select("doc_id").distinct()
    if gone.count() <= minhash.BROADCAST_IDS:
        gone = F.broadcast(gone)
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if groups.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    row = F.struct(*docs.columns)
    first = F.min_by(row, F.struct(F.sha2(F.coalesce("text", F.lit("")), 256), F.to_json(row)))
    once = left.where("doc_id IS NOT NULL").groupBy("doc_id").agg(first.alias("row")).select("row.*")
    return once.unionAll(left.where("doc_id IS NULL"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    importable(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewrites texts with surrogates; ``n_chars`` follows."""
    out = surrogates.pseudonymise(docs, KEY, count_col=None)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with the sequence and place they go to."""
    importable(spark)
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", languages),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("pii_surrogates", without_personal_data),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; what a stage returns is written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs


ORACLE_SQL = None
