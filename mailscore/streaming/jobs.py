"""Streaming intake, de-duplication and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailscore.plans.score import score_table
from mailscore.plans.train import TrainedModel
from mailscore.sources import readers
from mailscore.sources.memory import DatasetMemory
from mailscore.sources.message_store import MessageStore
from mailscore.sources.sinks import prediction_records

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_intake(
    spark: SparkSession, incoming: str, memory: DatasetMemory, checkpoint: str, files_per_trigger: int = 100
) -> StreamingQuery:
    """Cache data-set files as they arrive; content seen before is skipped.

    A batch holds file names only. A repeated batch finds its files already
    cached, so it adds nothing.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", str(files_per_trigger))
        .load(incoming)
        .select("path")
    )

    def cache(batch: DataFrame, _batch_id: int) -> None:
        paths = sorted(r.path for r in batch.collect())  # bounded by files_per_trigger
        wanted = [p for p in paths if readers.is_dataset_file(p)]
        if wanted:
            memory.cache(wanted)

    return (
        files.writeStream.foreachBatch(cache).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def deduplicate(messages: DataFrame, delay: str = "1 day", ts: str = "received_at") -> DataFrame:
    """The first message of each (user, message id); keys older than the delay are forgotten (not so :func:`store_stream`)."""
    return messages.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["user_id", "message_id"])


def store_stream(messages: DataFrame, into: MessageStore, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """The first message of each key, kept in a store, however long ago it came.

    The store is the memory of the stream: nothing is forgotten and no state
    grows in the executors. A batch that is run again after a failure replaces
    its own rows. Streams that share a store need names of their own, and only
    one may write at a time.
    """

    def insert(batch: DataFrame, batch_id: int) -> None:
        into.insert(batch, f"{name}-{batch_id}")

    return (
        messages.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def score_stream(emails: DataFrame, model: TrainedModel, path: str, checkpoint: str, text: str = "body") -> StreamingQuery:
    """Score emails as they arrive and append prediction records."""
    scored = score_table(emails, model, text)
    records = prediction_records(scored, model.version).withColumn("created_at", F.current_timestamp())
    return (
        records.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def append_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet table."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
