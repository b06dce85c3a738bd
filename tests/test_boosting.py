"""Trees grown by one task are the trees that MLlib grows."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from mailscore import constants as c
from mailscore.plans import boosting, draws, forest, train
from mailscore.session import ensure_checkpoint_dir


def vectors(spark, n, parts=3):
    """Half empty columns of many values, a full one, one that is always zero, and categories."""
    ensure_checkpoint_dir(spark)
    sparse = [F.when(F.rand(10 + i) < 0.4 + 0.1 * i, F.round(F.randn(i), 9)).otherwise(0.0).alias(f"x{i}") for i in range(5)]
    df = spark.range(n, numPartitions=2).select("id", *sparse, F.rand(77).alias("u"), F.lit(0.0).alias("z"), F.pmod(F.xxhash64("id"), F.lit(4)).cast("double").alias("k"))
    df = df.withColumn("label", (F.col("x3") + F.col("x1") * F.col("x2") + F.col("k") * 0.5 + F.col("u") > 1.2).cast("int"))
    df = OneHotEncoder(inputCol="k", outputCol="kinds").fit(df).transform(df)
    df = VectorAssembler(inputCols=[*(f"x{i}" for i in range(5)), "u", "z", "kinds"], outputCol="features").transform(df)
    return df.select("label", "features").repartition(parts).checkpoint()


def classifier(**settings):
    given = dict(maxIter=2, maxDepth=3, stepSize=0.3, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42) | settings
    return GBTClassifier(labelCol="label", featuresCol="features", **given)


def nodes(spark, model):
    return sorted(forest.nodes_of(spark, type("Model", (), {"stages": [model]})).collect(), key=lambda r: (r.tree, r.node))


# of 12,000 and 30,000 rows 10,000 are looked at for split candidates, drawn in two ways
@pytest.mark.parametrize(("n", "settings"), [(2000, dict(featureSubsetStrategy="all", maxDepth=2)), (12_000, {}), (30_000, dict(subsamplingRate=1.0))])
def test_same_trees_as_mllib(spark, n, settings):
    rows, estimator = vectors(spark, n), classifier(**settings)
    theirs, ours = estimator.fit(rows), boosting.fit(estimator, rows)
    a, b = nodes(spark, theirs), nodes(spark, ours)
    assert [(x.tree, x.node, x.feature, x.cut, x.left_values, x.left, x.right, x.weight) for x in a] == [
        (x.tree, x.node, x.feature, x.cut, x.left_values, x.left, x.right, x.weight) for x in b
    ]
    assert np.allclose([x.value for x in a], [x.value for x in b], rtol=1e-9, atol=1e-12)
    assert str(theirs.extractParamMap()) == str(ours.extractParamMap()) and (theirs.uid, theirs.numFeatures) == (ours.uid, ours.numFeatures)
    p, q = (m.transform(rows).select(vector_to_array("probability")[1].alias("p")).toPandas().p for m in (theirs, ours))
    assert (p - q).abs().max() < 1e-9


def test_kept_and_read_again(spark, tmp_path):
    rows = vectors(spark, 500)
    model = boosting.fit(classifier(), rows)
    model.write().save(str(tmp_path / "model"))
    again = type(model).load(str(tmp_path / "model"))
    assert again.toDebugString == model.toDebugString


def test_larger_inputs_and_other_settings_are_left_to_mllib(spark, monkeypatch):
    rows, estimator = vectors(spark, 300), classifier(maxIter=2, maxDepth=2)
    monkeypatch.setattr(boosting, "binned", lambda *a: pytest.fail("grown here"))
    assert boosting.fit(classifier(maxIter=2, maxDepth=2, minInstancesPerNode=5), rows).getNumTrees == 2
    monkeypatch.setattr(boosting, "ENTRIES", 10)
    assert boosting.fit(estimator, rows).getNumTrees == 2


def test_odd_rows(spark):
    one_class = vectors(spark, 200).withColumn("label", F.lit(1)).checkpoint()
    assert {r.value for r in nodes(spark, boosting.fit(classifier(maxIter=1), one_class))} == {1.0}
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        boosting.fit(classifier(), vectors(spark, 200).withColumn("label", F.lit(2)).checkpoint())
    same = vectors(spark, 40).limit(1).crossJoin(spark.range(50).select((F.col("id") % 2).cast("int").alias("l"))).select(F.col("l").alias("label"), "features")
    assert all(r.feature is None for r in nodes(spark, boosting.fit(classifier(maxIter=1), same.checkpoint())))  # nothing to split by


def test_java_draws(spark):
    jvm = spark.sparkContext._jvm
    for seed in (0, 42, -7, 1 << 40):
        theirs = jvm.java.util.Random(seed)
        assert draws.java_longs(seed, 3) == [theirs.nextLong() for _ in range(3)]
        theirs = jvm.org.apache.spark.util.random.XORShiftRandom(seed)
        mine, many = draws.XorShift(seed), draws.XorShifts([seed, 5])
        expected = [theirs.nextDouble() for _ in range(5)]
        assert [mine.double() for _ in range(5)] == expected == [many.doubles()[0] for _ in range(5)]


def test_few_jobs_for_many_rounds(spark):
    """Before: a job for each level of each tree."""
    sc = spark.sparkContext
    rows = spark.range(400).select(
        (F.col("id") % 2).cast("int").alias("label"), F.concat(F.lit("word"), (F.col("id") % 7).cast("string"), F.when(F.col("id") % 2 == 1, " prize").otherwise(" report")).alias("text"),
        *[F.lit("a.org").alias(x) if x == "sender_domain" else (F.col("id") % (i + 2)).cast("double").alias(x) for i, x in enumerate(c.FEATURE_COLUMNS) if x != "text"],
    )
    sc.setJobGroup("boosting", "rounds")
    try:
        model = train.fit_model(rows, train.Settings(rounds=25, depth=4, vocabulary=20))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert model.stages[-1].getNumTrees == 25
    assert len(sc.statusTracker().getJobIdsForGroup("boosting")) < 100


def test_scores_a_stream(spark, tmp_path):
    rows = vectors(spark, 300)
    model = boosting.fit(classifier(maxIter=2, maxDepth=2), rows)
    rows.write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    scored = model.transform(arriving).select(vector_to_array("probability")[1].alias("p"))
    scored.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
    batch = model.transform(rows).select(vector_to_array("probability")[1].alias("p"))
    assert sorted(r.p for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(r.p for r in batch.collect())
