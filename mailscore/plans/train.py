"""Training: history → rows → split → TF-IDF + scaling + one-hot → boosted trees → threshold → report."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import (
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mailscore import constants as c
from mailscore.functions import labels
from mailscore.functions import text as tx
from mailscore.operators import analytics, evaluation, quality, ranking, schema
from mailscore.operators import terms as tm
from mailscore.plans import boosting
from mailscore.session import ensure_checkpoint_dir

HASH_SLICE_BITS = 14

# Training rows of a task: four bytes a column, as MLlib holds them, up to so many bytes; over FEW_TASKS tasks, so many rows at least.
TASK_BYTES, FEW_TASKS, LEAST_ROWS = 300_000_000, 16, 1000


@dataclass
class Settings:
    """What may be changed about a training run."""

    rounds: int = c.GBT_ROUNDS
    depth: int = c.GBT_DEPTH
    rate: float = c.GBT_RATE
    row_share: float = c.GBT_ROW_SHARE
    column_share: float = c.GBT_COLUMN_SHARE
    vocabulary: int = c.VOCABULARY_SIZE
    seed: int = c.SEED
    test_share: float = c.TEST_SHARE
    stop_words: list[str] = field(default_factory=lambda: list(c.STOP_WORDS))


def training_rows(
    history: DataFrame,
    text: str | None = None,
    label: str | None = None,
    strict: bool = True,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """label and the seven features (and the columns to keep) of every usable row.

    An unknown label stops the job if ``strict``, else the row is left out.
    """
    df = schema.normalize_columns(history)
    label = schema.label_column(df, label)
    df = df.withColumn("_raw", schema.text_expression(df, text)).where(F.col("_raw").isNotNull())
    df = schema.ensure_features(df, "_raw").withColumn(
        "text", F.coalesce(tx.normalize_text(F.col("_raw")), F.lit(""))
    )
    columns = [*c.FEATURE_COLUMNS, *keep]
    rows = schema.required_rows(df.withColumnRenamed(label, "_label"), "_label", columns)
    if strict:
        return rows.select(labels.strict_label(F.col("_label")).alias("label"), *columns)
    return quality.quarantine_labels(rows, "_label")[0].select("label", *columns)


def stratified_split(
    df: DataFrame, label: str, row_hash: Column, test_share: float = c.TEST_SHARE, tie: list[Column] | None = None
) -> DataFrame:
    """Adds is_test: exactly the given share (rounded) of each label, the same rows on every run.

    ``row_hash`` must tell rows apart, also those of equal content, or equal rows
    would meet in one task. The rows with the lowest hashes are the test rows. The hash range is cut
    into slices; counts per (label, slice) tell which slice holds the last test
    row, and only the rows of that one slice are shuffled and put in order.
    """
    bits = 64 - HASH_SLICE_BITS
    # the sign bit is flipped so that slices ascend with the hash
    hashed = df.withColumns({"_hash": row_hash}).withColumn(
        "_slice", F.shiftrightunsigned(F.col("_hash").bitwiseXOR(F.lit(-(1 << 63))), bits)
    )
    counts = hashed.groupBy(label, "_slice").agg(F.count("*").alias("_n"))
    upto = W.partitionBy(label).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    wanted = F.round(F.sum("_n").over(W.partitionBy(label)) * F.lit(test_share)).cast("bigint")
    # at most 2^HASH_SLICE_BITS rows per label
    room = counts.select(
        label, "_slice", "_n", (wanted - F.coalesce(F.sum("_n").over(upto), F.lit(0))).alias("_room")
    )
    placed = ranking.join_null_safe(hashed, ranking.broadcast_if_small(room), [label, "_slice"])
    whole = (F.col("_room") <= 0) | (F.col("_room") >= F.col("_n"))
    rank = F.row_number().over(W.partitionBy(label, "_slice").orderBy(F.col("_hash"), *(tie or [])))
    decided = placed.where(whole).withColumn("is_test", F.col("_room") > 0)
    edge = placed.where(~whole).withColumn("is_test", rank <= F.col("_room"))
    return decided.unionByName(edge).drop("_hash", "_slice", "_n", "_room")


def _fit_transform(estimator, df: DataFrame):
    model = estimator.fit(df)
    return model, model.transform(df)


def fit_features(train: DataFrame, settings: Settings) -> tuple[PipelineModel, DataFrame]:
    """(fitted feature stages, training rows with the ``features`` vector)."""
    weights = tm.Weights.fit(train, "text", settings.vocabulary, settings.stop_words)
    rows = tm.add_terms(train, "text", stop_words=settings.stop_words)
    # one column per known domain; the last index stands for unseen ones and is left out of the one-hot columns
    domain = [
        StringIndexer(inputCol="sender_domain", outputCol="_domain", handleInvalid="keep"),
        OneHotEncoder(inputCol="_domain", outputCol="_domain_columns", dropLast=True),
    ]
    stages = [
        *weights.stages("terms", "_tfidf"),
        VectorAssembler(inputCols=c.FEATURE_NUMERIC, outputCol="_numbers"),
        StandardScaler(withMean=True, withStd=True, inputCol="_numbers", outputCol="_scaled"),
        *domain,
        VectorAssembler(inputCols=["_tfidf", "_scaled", "_domain_columns"], outputCol="features"),
    ]
    fitted = []
    for stage in stages:
        if hasattr(stage, "fit"):
            stage, rows = _fit_transform(stage, rows)
        else:
            rows = stage.transform(rows)
        fitted.append(stage)
    return PipelineModel(fitted), rows.select("label", "features")


def dealt_for_trees(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` training rows dealt evenly to a task for each core, or to more where these would be too large.

    At every level of every tree each task sums up all bins of all columns for each node, and these sums are sent and
    added up. That costs as much as some 2,400 rows however few a task has, so tasks beyond the cores only cost time.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    columns = rows.schema["features"].metadata["ml_attr"]["num_attrs"]
    tasks = max(1, min(cores, max(FEW_TASKS, n // LEAST_ROWS)))
    return rows.repartition(tasks * max(1, math.ceil(n * columns * 4 / (tasks * TASK_BYTES))))


def fit_model(train: DataFrame, settings: Settings) -> PipelineModel:
    """Feature stages and boosted trees fitted on the training rows."""
    features, rows = fit_features(train, settings)
    ensure_checkpoint_dir(train.sparkSession)
    rows = dealt_for_trees(rows, train.count()).checkpoint()  # the trees read the rows once per level
    estimator = GBTClassifier(
        labelCol="label",
        featuresCol="features",
        maxIter=settings.rounds,
        maxDepth=settings.depth,
        stepSize=settings.rate,
        subsamplingRate=settings.row_share,
        featureSubsetStrategy=str(settings.column_share),
        seed=settings.seed,
        maxMemoryInMB=1024,
    )
    return PipelineModel([*features.stages, boosting.fit(estimator, rows)])


def with_probability(rows: DataFrame, model: PipelineModel, stop_words: list[str] | None = None) -> DataFrame:
    """Adds the probability of class 1 to rows that carry the seven features."""
    out = model.transform(tm.add_terms(rows, "text", stop_words=stop_words))
    return out.withColumn("probability", vector_to_array("probability")[1]).select(*rows.columns, "probability")


@dataclass
class TrainedModel:
    """Fitted stages with the cut points and names that belong to them."""

    stages: PipelineModel
    threshold: float = c.DEFAULT_THRESHOLD
    margin: float = c.SUSPICIOUS_MARGIN
    version: str = "unknown"
    stop_words: list[str] = field(default_factory=lambda: list(c.STOP_WORDS))

    def save(self, spark: SparkSession, path: str) -> None:
        self.stages.write().overwrite().save(f"{path}/stages")
        params = spark.createDataFrame(
            [(self.threshold, self.margin, self.version, c.FEATURE_COLUMNS, {"1": "phishing", "0": "legitimate"}, self.stop_words)],
            "threshold double, suspicious_margin double, version string, feature_cols array<string>, "
            "label_mapping map<string,string>, stop_words array<string>",
        )
        params.coalesce(1).write.mode("overwrite").json(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TrainedModel:
        """A saved model; cut points and version that are not there take their defaults."""
        wanted = "threshold double, suspicious_margin double, version string, stop_words array<string>"
        p = spark.read.schema(wanted).json(f"{path}/params").first()
        return cls(
            PipelineModel.load(f"{path}/stages"),
            c.DEFAULT_THRESHOLD if p.threshold is None else p.threshold,
            c.SUSPICIOUS_MARGIN if p.suspicious_margin is None else p.suspicious_margin,
            p.version or "unknown",
            list(c.STOP_WORDS) if p.stop_words is None else list(p.stop_words),
        )

    def probability(self, rows: DataFrame) -> DataFrame:
        return with_probability(rows, self.stages, self.stop_words)


@dataclass
class TrainingRun:
    model: TrainedModel
    scored_test: DataFrame
    sweep: DataFrame
    report: DataFrame
    summary: DataFrame


def train(
    rows: DataFrame,
    settings: Settings | None = None,
    version: str = "unknown",
    dataset: str | None = None,
    row_id: str | None = None,
) -> TrainingRun:
    """Fit on 80 per cent, choose the threshold and report on the rest.

    ``rows`` carries label and the seven features, and, where named, the data
    set a row came from and its id. Rows without an id get one that is fixed by
    writing them out before the split.
    """
    settings = settings or Settings()
    ensure_checkpoint_dir(rows.sparkSession)
    if not row_id:
        row_id = "_row"
        rows = rows.withColumn(row_id, F.monotonically_increasing_id()).checkpoint()
    split = stratified_split(
        rows, "label", F.xxhash64(row_id, F.lit(settings.seed)), settings.test_share, [F.col(row_id)]
    ).checkpoint()  # both sides must see the same cut
    train_rows, test_rows = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    stages = fit_model(train_rows, settings)
    scored = with_probability(test_rows, stages, settings.stop_words).select("label", "probability").checkpoint()
    sweep = evaluation.threshold_sweep(scored)
    best = evaluation.best_threshold(sweep).first()
    model = TrainedModel(stages, best.threshold, c.SUSPICIOUS_MARGIN, version, settings.stop_words)
    cut = scored.withColumn("prediction", (F.col("probability") >= best.threshold).cast("int"))
    tagged = rows if dataset else rows.withColumn("_dataset", F.lit("all"))
    summary = (
        analytics.run_summary(tagged, dataset or "_dataset", "label")
        .withColumn("feature_cols", F.array(*[F.lit(n) for n in c.FEATURE_COLUMNS]))
        .withColumn("optimal_threshold", F.lit(best.threshold))
        .withColumn("optimal_f1_score", F.round(F.lit(best.weighted_f1), 4))
        .withColumn("version", F.lit(version))
    )
    return TrainingRun(model, scored, sweep, evaluation.classification_report(cut), summary)
