"""The table of trees scores as the model does."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from mailscore.plans import forest


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(600).select(
        "id", (F.col("id") % 7).cast("double").alias("a"), F.rand(1).alias("b"), (F.col("id") % 5).cast("double").alias("kind"),
        ((F.col("id") % 7 > 3) | (F.col("id") % 5 == 2)).cast("int").alias("label"),
    )
    coded = OneHotEncoder(inputCol="kind", outputCol="kinds").fit(df).transform(df)
    return VectorAssembler(inputCols=["a", "b", "kinds"], outputCol="features").transform(coded)


@pytest.mark.parametrize(("rounds", "depth"), [(1, 1), (12, 4)])
def test_same_probability(spark, rows, tmp_path, rounds, depth):
    trees = GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.3, subsamplingRate=0.8, seed=7).fit(rows)
    model = PipelineModel([trees])
    nodes = forest.nodes_of(spark, model)
    assert nodes.schema.simpleString() == spark.createDataFrame([], forest.COLUMNS).schema.simpleString()
    nodes.write.parquet(str(tmp_path / "nodes"))
    kept = spark.read.parquet(str(tmp_path / "nodes"))
    assert forest.depth(kept) <= depth
    per_tree = kept.groupBy("tree").agg(F.count("*").alias("n"), F.count("feature").alias("inner")).collect()
    assert len(per_tree) == rounds and all(r.n == 2 * r.inner + 1 for r in per_tree)
    both = forest.with_probability(model.transform(rows).withColumnRenamed("probability", "theirs"), kept)
    worst = both.select(F.max(F.abs(F.col("probability") - vector_to_array("theirs")[1])).alias("d"), F.count("probability").alias("n")).first()
    assert worst.n == 600 and worst.d < 1e-9


def test_no_join_and_no_python(spark, rows):
    trees = GBTClassifier(labelCol="label", maxIter=2, maxDepth=2).fit(rows)
    scored = forest.with_probability(rows, forest.nodes_of(spark, PipelineModel([trees])).checkpoint())
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan.split("Subquery")[0]


def test_other_models_are_refused(spark):
    with pytest.raises(TypeError):
        forest.nodes_of(spark, PipelineModel([VectorAssembler(inputCols=["a"], outputCol="f")]))
