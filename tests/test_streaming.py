"""Streams give what the batch jobs give."""

from pyspark.sql import functions as F

from mailscore.plans import train as tr
from mailscore.plans.score import score_table
from mailscore.sources import memory
from mailscore.sources.message_store import MessageStore
from mailscore.streaming import jobs
from test_store import trained  # noqa: F401  (a fixture)


def test_intake(spark, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    (incoming / "a.csv").write_text("body,label\nx,1\n")
    (incoming / "note.bin").write_text("no data set")
    store = memory.DatasetMemory(spark, str(tmp_path / "history"))

    def run():
        jobs.stream_intake(spark, str(incoming), store, str(tmp_path / "state"), files_per_trigger=1).awaitTermination()

    run()
    (incoming / "b.csv").write_text("body,kind\ny,0\n")
    (incoming / "again.csv").write_text("body,label\nx,1\n")
    run()
    run()
    assert store.load().count() == 2
    assert store.manifest().count() == 2


def test_dedupe_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for day in range(3):
        events.where(F.pmod("event_id", F.lit(3)) == day).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    messages = stream.select("user_id", F.col("event_type").alias("message_id"), F.col("ts").cast("timestamp").alias("received_at"))
    query = jobs.append_stream(jobs.deduplicate(messages, "3650 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    want = events.select("user_id", F.col("event_type").alias("message_id")).distinct()
    assert out.count() == want.count()
    assert out.select("user_id", "message_id").exceptAll(want).count() == 0


def test_the_store_remembers_longer_than_any_delay(spark, tmp_path):
    schema = "user_id bigint, message_id string, email_id bigint, received_at timestamp_ntz"
    rows = [(1, "a", 10, "2010-01-01"), (1, "b", 11, "2010-01-01"), (1, "a", 12, "2010-01-02"), (None, "a", 13, None)]
    late = [(1, "a", 20, "2024-01-01"), (2, "a", 21, "2024-01-01"), (1, "c", 22, "2009-01-01"), (None, "a", 23, None)]
    into = MessageStore(spark, str(tmp_path / "store"), spark.createDataFrame([], schema).schema, buckets=8)
    for i, delivery in enumerate((rows, late, late[:2])):
        df = spark.createDataFrame(delivery, "user_id bigint, message_id string, email_id bigint, at string")
        df.withColumn("received_at", F.col("at").cast("timestamp_ntz")).drop("at").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.store_stream(stream, into, str(tmp_path / "state")).awaitTermination()
    assert sorted(r.email_id for r in into.rows().collect()) == [10, 11, 13, 21, 22, 23]


def test_a_batch_opens_only_the_buckets_of_its_keys(spark, tmp_path):
    schema = spark.createDataFrame([], "user_id bigint, message_id string, email_id bigint").schema
    into = MessageStore(spark, str(tmp_path / "store"), schema, buckets=16)
    assert into.rows().count() == 0
    # keys of another integer type fall into the same buckets; columns the store lacks are left out
    many = spark.range(400).selectExpr("cast(id % 20 as int) AS user_id", "concat('m', id % 100) AS message_id", "id AS email_id", "1 AS more")
    for _ in range(2):  # once more: nothing changes
        into.insert(many, "first")
        assert into.rows().count() == into.rows().select("user_id", "message_id").distinct().count() == 100
    asked = spark.createDataFrame([(3, "m3", 900), (3, "new", 901)], "user_id int, message_id string, email_id bigint")
    near = into.near(asked)
    assert 0 < len(near.inputFiles()) <= len(into.rows().inputFiles())
    assert 1 <= near.count() < 40 and "_bucket" in near._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    assert {r.email_id: r.stored_email_id for r in into.resolve(asked).collect()} == {900: 3, 901: 901}
    into.insert(asked, "second")
    assert into.rows().count() == 101
    into.insert(many.limit(0), "empty")
    assert into.rows().count() == 101


def test_scoring_equals_batch(spark, trained, tmp_path):  # noqa: F811
    emails = spark.createDataFrame([(i, f"verify account prize {i}" if i % 2 else "meeting agenda") for i in range(20)], "email_id bigint, body string")
    emails.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(emails.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.score_stream(stream, trained.model, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = score_table(emails, trained.model, "body")
    assert {(r.email_id, r.prediction) for r in out.collect()} == {(r.email_id, r.prediction) for r in batch.collect()}
    assert {r.model_version for r in out.collect()} == {"v7"}
    assert isinstance(trained.model, tr.TrainedModel)
