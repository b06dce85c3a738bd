"""Boosted trees as a table, and its scores by lookups inside the row.

A fitted model is a row for every node: tree, node, feature, cut, left_values, left, right, value, weight. It can be kept,
read and queried like any table. To score, the table (bounded by trees and depth, not by data) becomes one
value that every task holds, and each row walks down all trees in its own array of features: no join, no shuffle, no
Python.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailscore.session import ensure_checkpoint_dir

COLUMNS = (
    "tree int, node int, feature int, cut double, left_values array<double>, left int, right int, value double, weight double"
)


def nodes_of(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """The nodes of the boosted trees that end a pipeline; COLUMNS. A leaf has no feature and no children.

    A node goes left if its feature is not above the cut or, for a feature of few values, is one of ``left_values``.
    """
    trees = model.stages[-1]
    if not isinstance(trees, GBTClassificationModel):
        raise TypeError(f"the last stage is no boosted trees: {type(trees).__name__}")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    trees.write().save(folder)
    weights = spark.read.parquet(f"{folder}/treesMetadata").toDF("tree", "metadata", "weight").select("tree", "weight")
    stored = spark.read.parquet(f"{folder}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    inner = F.col("leftChild") >= 0
    by_value = F.col("split.numCategories") >= 0
    cut = F.get("split.leftCategoriesOrThreshold", F.lit(0))
    return stored.join(F.broadcast(weights), "tree").select(  # a row for each tree
        "tree",
        F.col("id").alias("node"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner & ~by_value, cut).alias("cut"),
        F.when(inner & by_value, F.col("split.leftCategoriesOrThreshold")).alias("left_values"),
        F.when(inner, F.col("leftChild")).alias("left"),
        F.when(inner, F.col("rightChild")).alias("right"),
        F.col("prediction").alias("value"),
        "weight",
    )


def _packed(nodes: DataFrame) -> tuple[Column, int]:
    """All trees as one value, each an array of its nodes by number, and the length of the longest walk."""
    fields = ["node", "feature", "cut", "left_values", "left", "right", "value"]
    trees = nodes.groupBy("tree", "weight").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("nodes"))
    whole = trees.agg(F.array_sort(F.collect_list(F.struct("tree", "weight", "nodes"))).alias("trees"))
    return whole.scalar(), depth(nodes)


def depth(nodes: DataFrame) -> int:
    """Most steps from a root to a leaf; nodes are numbered from the root down, left before right."""
    at, steps = nodes.where("node = 0").select("tree", "node"), 0
    children = nodes.where("left IS NOT NULL").select("tree", "node", F.array("left", "right").alias("next"))
    while True:
        at = at.join(children, ["tree", "node"]).select("tree", F.explode("next").alias("node")).checkpoint()
        if at.isEmpty():
            return steps
        steps += 1


def margin(trees: Column, steps: int, features: Column) -> Column:
    """Sum over all trees of weight times the value of the leaf that the features lead to."""

    def down(tree: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            node = F.get(tree["nodes"], at)
            x = F.get(features, node["feature"])
            left = F.when(node["left_values"].isNull(), x <= node["cut"]).otherwise(F.array_contains(node["left_values"], x))
            return F.when(node["left"].isNull(), at).when(left, node["left"]).otherwise(node["right"])

        leaf = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), step) if steps else F.lit(0)
        return F.get(tree["nodes"], leaf)["value"]

    return F.aggregate(trees, F.lit(0.0), lambda total, tree: total + tree["weight"] * down(tree))


def probability(trees: Column, steps: int, features: Column) -> Column:
    """Probability of class 1 under the logistic loss: 1 / (1 + exp(-2 margin))."""
    return 1 / (1 + F.exp(-2 * margin(trees, steps, features)))


def with_probability(rows: DataFrame, nodes: DataFrame, features: str = "features", out: str = "probability") -> DataFrame:
    """Adds the probability of class 1 to rows with a vector of features, from the table alone. Null without features."""
    ensure_checkpoint_dir(rows.sparkSession)
    trees, steps = _packed(nodes)
    held = rows.withColumns({"_trees_": trees, "_places_": vector_to_array(features)})
    return held.withColumn(out, probability(F.col("_trees_"), steps, F.col("_places_"))).drop("_trees_", "_places_")
