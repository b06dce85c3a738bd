"""Emails on disk, in buckets of their key, so that a batch opens only the files that can hold its keys."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from mailscore.operators import store


class MessageStore:
    """A table that holds every key once and forgets none.

    ``schema`` names the columns, with ``email_id`` and those of ``keys`` among
    them. Rows lie under their batch and the bucket of their key; a batch that is
    run again replaces its own rows and nothing else. The number of buckets is
    fixed for the life of a store: some thousands for the largest ones.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType, keys: list[str] | None = None, buckets: int = 64
    ) -> None:
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets
        self.keys = keys or store.MESSAGE_KEY

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _typed(self, df: DataFrame) -> DataFrame:
        """The columns of the store in its types: a key's bucket depends on them."""
        return df.select(*[F.col(f"`{x.name}`").cast(x.dataType).alias(x.name) for x in self.schema])

    def _stored(self) -> DataFrame:
        schema = StructType(list(self.schema)).add("_batch", StringType()).add("_bucket", IntegerType())
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """Everything stored."""
        return self._stored().select(*self.schema.names)

    def near(self, df: DataFrame, but: str | None = None) -> DataFrame:
        """The stored rows in the buckets of these keys, without those of the batch ``but``; other files stay closed."""
        asked = [r.b for r in self._typed(df).select(self._bucket().alias("b")).distinct().collect()]  # at most ``buckets``
        held = self._stored().where(F.col("_bucket").isin(asked))
        if but is not None:
            held = held.where(F.col("_batch") != but)
        return held.select(*self.schema.names)

    def insert(self, batch: DataFrame, batch_id: str) -> None:
        """Adds the first row of every key that is not stored yet; rows with a null in their key all stay.

        The same batch under the same id leaves the store as it is.
        """
        batch = self._typed(batch)
        new = store.keyed_insert(batch, self.near(batch, batch_id), self.keys)
        placed = new.withColumns({"_batch": F.lit(batch_id), "_bucket": self._bucket()}).hint("rebalance", "_bucket")
        (
            placed.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("_batch", "_bucket")
            .parquet(self.path)
        )

    def resolve(self, incoming: DataFrame) -> DataFrame:
        """The incoming rows with the id under which their key is, or would be, stored."""
        incoming = self._typed(incoming)
        return store.resolve_insert(incoming, self.near(incoming), self.keys)
