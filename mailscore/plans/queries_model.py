"""Registered queries: terms, TF-IDF, evaluation, feature vectors, boosted trees."""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscore import constants as c
from mailscore.functions import risk
from mailscore.functions import text as tx
from mailscore.operators import evaluation, schema, scoring, store
from mailscore.operators import terms as tm
from mailscore.plans import forest
from mailscore.plans import oracle as o
from mailscore.plans import train as tr
from mailscore.plans.queries_corpus import labelled
from mailscore.plans.queries_features import texts
from mailscore.plans.registry import R
from mailscore.plans.score import score_table
from mailscore.sources import fixtures as fx


def labelled_mail(spark, sf) -> DataFrame:
    return fx.text_emails(spark, sf).where(F.col("label").isNotNull()).select("email_id", "label", "body")


# ------------------------------------------------------------------------- terms
@R.query(
    "ag16_term_frequencies",
    f"""SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM doc_terms GROUP BY term ORDER BY cf DESC, term LIMIT {c.VOCABULARY_SIZE}""",
)
def term_frequencies(spark, sf):
    return tm.vocabulary(fx.text_table(spark, sf, "documents").select("text"), "text")


def differences(spark, sf) -> tuple[DataFrame, tm.Weights]:
    df = tm.tokenized(labelled_mail(spark, sf), "body")
    weights = tm.Weights.fit(df, "body")
    return tm.class_differences(df, weights, "body"), weights


@R.query(
    "ag17_class_differences",
    f"SELECT term, {o.r6('phishing')} AS phishing, {o.r6('legitimate')} AS legitimate, {o.r6('phishing - legitimate')} AS diff FROM term_diff",
)
def class_differences(spark, sf):
    df = differences(spark, sf)[0]
    return df.select("term", *[risk.round6(F.col(n)).alias(n) for n in ("phishing", "legitimate", "diff")])


_TOP = """SELECT * FROM (SELECT '{name}' AS class, term, round({sign} * (phishing - legitimate), 6) + 0.0 AS score FROM term_diff
  ORDER BY round({sign} * (phishing - legitimate), 6) DESC, term LIMIT 30)"""


@R.query(
    "tk1_indicator_terms",
    _TOP.format(name="phishing", sign="1") + " UNION ALL " + _TOP.format(name="legitimate", sign="-1"),
)
def indicator_terms(spark, sf):
    df = tm.indicator_terms(differences(spark, sf)[0])
    return df.withColumn("score", risk.round6(F.col("score")))


@R.query(
    "ml9_marking_terms",
    """SELECT CASE WHEN d > 0 THEN 'phishing' WHEN d < 0 THEN 'legitimate' ELSE 'neither' END AS marks, count(*) AS n
    FROM (SELECT round(phishing - legitimate, 6) AS d FROM term_diff) GROUP BY 1""",
)
def marking_terms(spark, sf):
    """How many terms of the vocabulary mark which class."""
    d = F.round("diff", 6)
    marks = F.when(d > 0, F.lit("phishing")).when(d < 0, F.lit("legitimate")).otherwise(F.lit("neither"))
    return differences(spark, sf)[0].groupBy(marks.alias("marks")).agg(F.count("*").alias("n"))


@R.query(
    "sc25_score_by_terms",
    f"""SELECT conv_id, turn, count(*) AS matched, {o.r6('avg(phishing - legitimate)')} AS avg_score,
      CASE WHEN avg(phishing - legitimate) > 0.001 THEN 'SUSPICIOUS' ELSE 'LIKELY SAFE' END AS verdict FROM (
      SELECT DISTINCT conv_id, turn, term FROM (SELECT conv_id, turn, unnest(list_concat(w,
        list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (
        SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), {o.quoted(c.TOKEN_RE)}),
          lambda w: w NOT IN {o.in_list(c.STOP_WORDS)}) AS w FROM conversations))) JOIN term_diff USING (term) GROUP BY conv_id, turn""",
)
def score_by_terms(spark, sf):
    diff, weights = differences(spark, sf)
    conversations = fx.text_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    df = tm.score_by_terms(conversations, "text", diff, ["conv_id", "turn"], weights)
    return df.withColumn("avg_score", risk.round6(F.col("avg_score")))


@R.query(
    "ml1_tfidf",
    f"SELECT email_id, count(*) AS terms, {o.r6('sum(w)')} AS weight, {o.r6('max(w)')} AS heaviest FROM weights GROUP BY email_id",
)
def tfidf(spark, sf):
    """Size, sum and largest weight of every TF-IDF vector."""
    df = tm.tokenized(labelled_mail(spark, sf), "body")
    w = F.filter(F.unwrap_udt("tfidf")["values"], lambda x: x > 0)  # filled places only
    rows = tm.Weights.fit(df, "body").tfidf(df, "body").select("email_id", w.alias("w")).where(F.size("w") > 0)
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "email_id",
        F.size("w").cast("bigint").alias("terms"),
        risk.round6(total).alias("weight"),
        risk.round6(F.array_max("w")).alias("heaviest"),
    )


# ------------------------------------------------------------------- evaluation
def scored_labels(spark, sf) -> DataFrame:
    latest = store.latest_predictions(fx.predictions(spark, sf))
    return labelled(spark, sf).select("email_id", "label").join(latest, "email_id").select("label", "probability", "prediction")


_SCORED = "(SELECT label, probability, prediction FROM emails JOIN latest USING (email_id) WHERE label IS NOT NULL)"
_SWEEP = f"""SELECT threshold, coalesce((pos * f1p + neg * f1n) / nullif(pos + neg, 0), 0) AS weighted_f1 FROM (
  SELECT threshold, pos, neg, coalesce(2 * tp / nullif(2 * tp + (pos - tp) + fp, 0), 0) AS f1p,
    coalesce(2 * (neg - fp) / nullif(2 * (neg - fp) + fp + (pos - tp), 0), 0) AS f1n FROM (
    SELECT t AS threshold, count_if(label = 1)::DOUBLE AS pos, count_if(label = 0)::DOUBLE AS neg,
      count_if(label = 1 AND probability >= t)::DOUBLE AS tp, count_if(label = 0 AND probability >= t)::DOUBLE AS fp
    FROM {_SCORED}, (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in c.SWEEP_THRESHOLDS)}]) AS t) GROUP BY t))"""


@R.query("ag14_threshold_sweep", f"SELECT threshold, {o.r6('weighted_f1')} AS weighted_f1 FROM ({_SWEEP})")
def threshold_sweep(spark, sf):
    df = evaluation.threshold_sweep(scored_labels(spark, sf))
    return df.withColumn("weighted_f1", risk.round6(F.col("weighted_f1")))


@R.query(
    "tk5_best_threshold",
    f"SELECT threshold, {o.r6('weighted_f1')} AS weighted_f1 FROM ({_SWEEP}) s ORDER BY s.weighted_f1 DESC, threshold LIMIT 1",
)
def best_threshold(spark, sf):
    df = evaluation.best_threshold(evaluation.threshold_sweep(scored_labels(spark, sf)))
    return df.withColumn("weighted_f1", risk.round6(F.col("weighted_f1")))


def _report_sql(predicted: str) -> str:
    return f"""SELECT class, {o.r6('precision')} AS precision, {o.r6('recall')} AS recall, {o.r6('f1')} AS f1, support FROM (
  WITH k AS (SELECT count_if(label = 1 AND q = 1)::DOUBLE AS tp, count_if(label = 0 AND q = 1)::DOUBLE AS fp,
      count_if(label = 1 AND q = 0)::DOUBLE AS fn, count_if(label = 0 AND q = 0)::DOUBLE AS tn
      FROM (SELECT label, {predicted} AS q FROM {_SCORED})),
    m AS (SELECT coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0,
      coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f0, tn + fp AS s0,
      coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1,
      coalesce(2 * tp / nullif(2 * tp + fn + fp, 0), 0) AS f1, tp + fn AS s1,
      coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0) AS acc FROM k)
  SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0::BIGINT AS support FROM m UNION ALL
  SELECT '1', p1, r1, f1, s1::BIGINT FROM m UNION ALL
  SELECT 'accuracy', acc, acc, acc, (s0 + s1)::BIGINT FROM m UNION ALL
  SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, (s0 + s1)::BIGINT FROM m UNION ALL
  SELECT 'weighted avg', (p0 * s0 + p1 * s1) / nullif(s0 + s1, 0), (r0 * s0 + r1 * s1) / nullif(s0 + s1, 0),
    (f0 * s0 + f1 * s1) / nullif(s0 + s1, 0), (s0 + s1)::BIGINT FROM m)"""


def _rounded_report(df: DataFrame) -> DataFrame:
    return df.withColumns({n: risk.round6(F.col(n)) for n in ("precision", "recall", "f1")})


@R.query("ag13_classification_report", _report_sql("prediction"))
def classification_report(spark, sf):
    return _rounded_report(evaluation.classification_report(scored_labels(spark, sf)))


@R.query(
    "ml8_report_at_best_threshold",
    _report_sql(f"(probability >= (SELECT threshold FROM ({_SWEEP}) s ORDER BY s.weighted_f1 DESC, threshold LIMIT 1))::INT"),
)
def report_at_best_threshold(spark, sf):
    df = scored_labels(spark, sf)
    cut = evaluation.best_threshold(evaluation.threshold_sweep(df)).select("threshold").scalar()
    return _rounded_report(evaluation.classification_report(df.withColumn("prediction", (F.col("probability") >= cut).cast("int"))))


# ---------------------------------------------------------------- feature vectors
def feature_rows(spark, sf) -> DataFrame:
    df = schema.ensure_features(texts(spark, sf).select("email_id", "label", "text"), "text")
    return df.withColumn("text", tx.normalize_text(F.col("text"))).dropna(subset=["label"])


@R.query(
    "ml2_scaled_numbers",
    "SELECT email_id, "
    + ", ".join(
        f"coalesce(round(({n} - avg({n}) OVER ()) / nullif(stddev_samp({n}) OVER (), 0), 6), 0) + 0.0 AS {n}"
        for n in c.FEATURE_NUMERIC
    )
    + " FROM feat WHERE label IS NOT NULL",
)
def scaled_numbers(spark, sf):
    df = feature_rows(spark, sf).select("email_id", *c.FEATURE_NUMERIC)
    numbers = VectorAssembler(inputCols=c.FEATURE_NUMERIC, outputCol="n").transform(df)
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="n", outputCol="s").fit(numbers)
    scaled = scaler.transform(numbers).select("email_id", vector_to_array("s").alias("s"))
    return scaled.select("email_id", *[risk.round6(F.col("s")[i]).alias(n) for i, n in enumerate(c.FEATURE_NUMERIC)])


@R.query(
    "ml3_domain_index",
    """SELECT sender_domain, (row_number() OVER (ORDER BY count(*) DESC, sender_domain) - 1)::DOUBLE AS idx, count(*) AS n
    FROM feat WHERE label IS NOT NULL GROUP BY sender_domain""",
)
def domain_index(spark, sf):
    """The one-hot position of every sender domain: the most frequent first."""
    df = feature_rows(spark, sf).select("sender_domain")
    indexed = StringIndexer(inputCol="sender_domain", outputCol="idx", handleInvalid="keep").fit(df).transform(df)
    return indexed.groupBy("sender_domain", "idx").agg(F.count("*").alias("n"))


@R.query("ml4_feature_vectors")
def feature_vectors(spark, sf):
    """Width and filled places of the combined vectors."""
    rows = tr.fit_features(feature_rows(spark, sf).select("label", *c.FEATURE_COLUMNS), tr.Settings())[1]
    v = F.unwrap_udt("features")  # as it is stored: only filled places of a sparse one
    width = F.coalesce(v["size"], F.size(v["values"]))
    return rows.select("label", width.alias("width"), F.size(F.filter(v["values"], lambda x: x != 0)).alias("filled"))


@R.query(
    "ml6_stratified_split",
    """SELECT label, count(*) AS n, round(count(*) * 0.2::DOUBLE)::BIGINT AS n_test FROM emails WHERE label IS NOT NULL GROUP BY label""",
)
def stratified_split(spark, sf):
    df = labelled(spark, sf).select("email_id", "label")
    split = tr.stratified_split(df, "label", F.xxhash64("email_id", F.lit(c.SEED)), tie=[F.col("email_id")])
    return split.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("is_test")).alias("n_test"))


_RUNS: dict[tuple[str, str], tr.TrainingRun] = {}


def whole_run(spark, sf) -> tr.TrainingRun:
    """A training run with the default settings on all labelled emails; one for a session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        rows = feature_rows(spark, sf).select("email_id", "label", *c.FEATURE_COLUMNS)
        _RUNS.clear()
        _RUNS[key] = tr.train(rows, tr.Settings(), version="check", row_id="email_id")
    return _RUNS[key]


@R.query("ml5_boosted_trees")
def boosted_trees(spark, sf):
    """Report of a training run."""
    return whole_run(spark, sf).report


@R.query("ml7_batch_probability")
def batch_probability(spark, sf):
    """All emails scored with a freshly trained model."""
    model = whole_run(spark, sf).model
    scored = score_table(texts(spark, sf), model)
    return scored.select(
        "email_id",
        risk.round6(F.col("probability")).alias("probability"),
        risk.round6(F.col("ensemble_score")).alias("ensemble_score"),
        "classification",
    )


@R.query("ml7_forest_probability", "SELECT email_id, true AS same, true AS valid FROM emails")
def forest_probability(spark, sf):
    """Whether the trees, as a table, give every email the probability that the model gives it (to 1e-9)."""
    model = whole_run(spark, sf).model
    rows = scoring.extract_features(texts(spark, sf).withColumn("_raw", F.col("text")), "_raw").withColumn("text", tx.normalize_text(F.col("_raw")))
    by_model = model.stages.transform(tm.add_terms(rows, "text", stop_words=model.stop_words)).withColumn("_theirs", vector_to_array("probability")[1])
    scored = forest.with_probability(by_model, forest.nodes_of(spark, model.stages).checkpoint())
    return scored.select(
        "email_id", (F.abs(F.col("probability") - F.col("_theirs")) < 1e-9).alias("same"), F.col("probability").between(0, 1).alias("valid")
    )
