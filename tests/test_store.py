"""Store, ranking, evaluation, terms and training against plain Python on small tables."""

import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailscore import constants as c
from mailscore.operators import analytics, evaluation, quality, ranking, scoring, store, trust
from mailscore.operators import terms as tm
from mailscore.plans import score as score_module
from mailscore.plans import train as tr
from mailscore.plans.score import score_table
from mailscore.sources import sinks

few = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def skewed(n=600, seed=1):
    """(email_id, prediction_id, hour) rows, a third of them on one email."""
    rnd = random.Random(seed)
    return [(0 if rnd.random() < 0.34 else rnd.randrange(1, 40), i, rnd.randrange(0, 30)) for i in range(n)]


def predictions(spark, rows):
    df = spark.createDataFrame(rows, "email_id bigint, prediction_id bigint, h int")
    at = F.timestamp_add("HOUR", F.col("h"), F.lit("2024-01-01").cast("timestamp_ntz"))
    return df.select("email_id", "prediction_id", F.when(F.col("h") > 0, at).alias("created_at"))


def test_history_rank_of_a_hot_email(spark):
    rows = skewed()
    got = {r.prediction_id: r.history_rank for r in store.prediction_history(predictions(spark, rows)).collect()}
    by_email = defaultdict(list)
    for e, p, h in rows:
        by_email[e].append((h, p))
    want = {p: i + 1 for ps in by_email.values() for i, (h, p) in enumerate(sorted(ps, reverse=True))}
    assert got == want and len(got) == len(rows)


def test_latest_of_a_hot_email(spark):
    rows = [(e, p, h + 1) for e, p, h in skewed()]
    got = {r.email_id: r.prediction_id for r in store.latest_predictions(predictions(spark, rows)).collect()}
    assert got == {e: max((h, p) for x, p, h in rows if x == e)[1] for e in {r[0] for r in rows}}


@pytest.mark.parametrize("small", [True, False])
def test_first_arrivals_with_many_copies(spark, monkeypatch, small):
    rnd = random.Random(2)
    rows = [(i, 1, "hot" if rnd.random() < 0.34 else f"m{rnd.randrange(150)}") for i in range(400)]
    if not small:
        monkeypatch.setattr(ranking.broadcast_if_small, "__defaults__", (0,))
    df = spark.createDataFrame(rows, "email_id bigint, user_id bigint, message_id string")
    got = {(r.message_id, r.email_id) for r in store.first_arrivals(df).collect()}
    first = {}
    for i, _, m in rows:
        first.setdefault(m, i)
    assert got == set(first.items())


def test_keyed_insert_is_idempotent(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (3, 2, "a")], "email_id bigint, user_id bigint, message_id string")
    none = df.limit(0)
    added = store.keyed_insert(df, none)
    assert {r.email_id for r in added.collect()} == {1, 3}
    assert store.keyed_insert(df, added).count() == 0
    old = spark.createDataFrame([(9, 1, "a")], df.schema)
    got = {r.email_id: r.stored_email_id for r in store.resolve_insert(df, old).collect()}
    assert got == {1: 9, 2: 9, 3: 3}


def test_pages(spark):
    df = spark.createDataFrame([(i, 1) for i in range(30)], "email_id bigint, user_id bigint").withColumn("received_at", F.lit(1))
    assert [r.email_id for r in store.email_page(df, 1, 5, 10).collect()] == [19, 18, 17, 16, 15]
    assert {r.email_id for r in store.email_pages(df, 5, 10).collect()} == {15, 16, 17, 18, 19}
    for bad in (0, 101):
        with pytest.raises(ValueError):
            store.email_page(df, 1, bad)


def test_pages_cut_groups_before_the_shuffle(spark, sf):
    df = spark.range(1000).select(F.col("id").alias("email_id"), (F.col("id") % 3).alias("user_id"), F.col("id").alias("received_at"))
    plan = store.email_pages(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_ownership(spark):
    emails = spark.createDataFrame([(1, 10), (2, 20)], "email_id bigint, user_id bigint")
    asked = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "email_id bigint, user_id bigint")
    granted, denied = store.split_owned(asked, emails)
    assert [r.email_id for r in granted.collect()] == [1] and {r.email_id for r in denied.collect()} == {2, 3}
    outcomes = store.request_outcome(asked, emails)
    assert {r.email_id: r.outcome for r in outcomes.collect()} == {1: "ok", 2: "access denied", 3: "not found"}
    assert tuple(scoring.outcome_counts(outcomes).first()) == (3, 1, 2)


def test_dashboard_without_predictions(spark):
    df = spark.createDataFrame([(1, None, None)], "email_id int, prediction int, probability double")
    r = analytics.dashboard(df).first()
    assert (r.total, r.analyzed, r.not_analyzed, r.avg_confidence, r.phishing_percentage) == (1, 0, 1, 0.0, 0.0)


@few
@given(st.lists(st.tuples(st.integers(0, 60000), st.sampled_from([0, 1, None])), min_size=2, max_size=60))
def test_lengths(spark, rows):
    df = spark.createDataFrame(rows, "chars int, label int").groupBy("chars", "label").agg(F.count("*").alias("n"))
    xs = sorted(x for x, _ in rows)
    mean = sum(xs) / len(xs)
    got = analytics.length_description(df).first()
    assert (got["count"], got["min"], got["max"]) == (len(xs), xs[0], xs[-1])
    assert got["mean"] == pytest.approx(mean)
    assert got["std"] == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in xs) / (len(xs) - 1)), abs=1e-6)
    where = 0.25 * (len(xs) - 1)
    low = int(where)
    assert got["q25"] == pytest.approx(xs[low] + (where - low) * (xs[min(low + 1, len(xs) - 1)] - xs[low]))
    total = [r.n for r in analytics.length_crosstab(df).collect() if r.bucket == "All" and r.label == "All"]
    assert sum(total) == sum(1 for x, y in rows if x > 0 and y is not None)


@pytest.mark.parametrize("n, name", [(0, None), (1, "<100"), (100, "<100"), (101, "100-500"), (50000, "10K-50K"), (50001, ">50K")])
def test_bucket_edges(spark, n, name):
    assert spark.createDataFrame([(n,)], "n int").select(analytics.length_bucket(F.col("n")).alias("b")).first().b == name


@few
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.0, 0.3, 0.35, 0.5, 0.55, 0.7, 1.0])), min_size=1, max_size=40))
def test_sweep_and_report(spark, rows):
    df = spark.createDataFrame(rows, "label int, probability double")

    def f1(cls, t):
        pred = [(y, int(p >= t)) for y, p in rows]
        tp = sum(y == cls == q for y, q in pred)
        other = sum((y == cls) != (q == cls) for y, q in pred)
        return 2 * tp / (2 * tp + other) if tp else 0.0

    def weighted(t):
        return sum(f1(cls, t) * sum(y == cls for y, _ in rows) for cls in (0, 1)) / len(rows)

    sweep = {r.threshold: r.weighted_f1 for r in evaluation.threshold_sweep(df).collect()}
    assert sweep == {t: pytest.approx(weighted(t)) for t in c.SWEEP_THRESHOLDS}
    best = evaluation.best_threshold(evaluation.threshold_sweep(df)).first()
    assert best.weighted_f1 == pytest.approx(max(sweep.values()))
    cut = df.withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))
    report = {r["class"]: r for r in evaluation.classification_report(cut).collect()}
    assert report["weighted avg"].f1 == pytest.approx(weighted(0.5))
    assert report["accuracy"].f1 == pytest.approx(sum(y == int(p >= 0.5) for y, p in rows) / len(rows))
    assert report["1"].support == sum(y for y, _ in rows)


def test_ranks_of_a_group_longer_than_a_task_may_hold(spark):
    """One email with most predictions, all in one hour, and others; nulls are a group."""
    rows = spark.range(30_000).select(
        F.col("id").alias("prediction_id"),
        F.when(F.col("id") % 50 == 1, F.col("id") % 7).when(F.col("id") % 50 == 2, None).otherwise(99).alias("email_id"),
        (F.lit(1_700_000_000) + F.xxhash64("id") % 1800).cast("timestamp").alias("created_at"),
    ).repartition(5)
    order = [F.col("created_at").desc(), F.col("prediction_id").desc()]
    got = ranking.whole_row_number(rows, ["email_id"], order, "n", rows=2_000).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.email_id, []).append(r)
    assert len(got) == 30_000 and len(groups) == 9
    for group in groups.values():
        want = sorted(group, key=lambda r: (r.created_at, r.prediction_id), reverse=True)
        assert [r.n for r in want] == list(range(1, len(group) + 1))
    slices = ranking.ranged_slices(rows, ["email_id"], order, 2_000).groupBy("_slice").count()
    assert slices.agg(F.max("count")).first()[0] <= 2_000
    assert ranking.whole_row_number(rows.limit(0), ["email_id"], order, "n").collect() == []


def test_parents_are_looked_up_at_depths_of_the_list(spark):
    names = ["b.com", "x.co.uk", "d.e.f.g", "B.com"]
    domains = ["b.com", "a.b.com", "ab.com", "com", "x.co.uk", "y.x.co.uk", "co.uk", "q.d.e.f.g", "e.f.g", "", "b.com.", ".b.com", None]
    counts = trust.domain_counts(spark.createDataFrame([(d,) for d in domains], "domain string"))
    listed = spark.createDataFrame([(n,) for n in [*names, None]], "domain string")
    got = {r.domain for r in trust.trusted_domains(counts, listed).collect()}
    assert got == {d for d in domains if d is not None and any(d == n.lower() or d.endswith("." + n.lower()) for n in names)}
    made = spark.sql("SELECT 'a.b.com' AS d").select(trust.dot_suffixes(F.col("d"), [2, 3, 4]).alias("s")).first().s
    assert made == ["b.com", "a.b.com"]
    assert trust.trusted_domains(counts, listed.limit(0)).count() == 0


def test_useless_sweep_keeps_the_default(spark):
    df = spark.createDataFrame([(1, 0.0)], "label int, probability double")
    assert evaluation.best_threshold(evaluation.threshold_sweep(df)).first().threshold == 0.5


def term_counts(docs):
    cf, df = Counter(), Counter()
    for doc in docs:
        words = [w for w in doc.split() if w not in c.STOP_WORDS and len(w) > 1]
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        cf.update(terms)
        df.update(set(terms))
    return cf, df


@pytest.mark.parametrize("size", [3, 8, 25, 500])
def test_vocabulary_is_exact(spark, size):
    """Candidate words leave out no term that belongs in the vocabulary, ties included."""
    rnd = random.Random(5)
    docs = [" ".join(rnd.choice(["aa", "bb", "aa", "cc", "dd", "ee", f"x{rnd.randrange(30)}", "the"]) for _ in range(12)) for _ in range(40)]
    df = spark.createDataFrame([(d,) for d in docs], "text string")
    cf, dfs = term_counts(docs)
    want = sorted(cf.items(), key=lambda kv: (-kv[1], kv[0]))[:size]
    got = [(r.term, r.cf, r.df) for r in tm.vocabulary(df, "text", size).collect()]
    assert got == [(t, n, dfs[t]) for t, n in want]


def test_pruning_by_buckets_is_exact(spark, monkeypatch):
    """Few buckets let more terms through and lose none; most of what cannot be in the vocabulary goes before it is counted."""
    rnd = random.Random(9)
    docs = [" ".join(f"w{int(rnd.paretovariate(0.7)) % 900}" for _ in range(60)) for _ in range(300)] + ["", None, "w1"]
    df = spark.createDataFrame([(d,) for d in docs], "text string")
    cf, dfs = term_counts([d for d in docs if d])
    want = sorted(cf.items(), key=lambda kv: (-kv[1], kv[0]))[:40]
    words = tm.tokenized(df, "text")
    for buckets in (64, 1 << 18):
        monkeypatch.setattr(tm, "BUCKETS", buckets)
        assert [(r.term, r.cf, r.df) for r in tm.vocabulary(words, "text", 40).collect()] == [(t, n, dfs[t]) for t, n in want]
    left = tm.frequent_terms(words, "text", 40).select(F.explode("terms").alias("t")).distinct().count()
    assert left < len(cf) / 10


def test_scores_by_terms_stay_in_their_row(spark):
    df = spark.createDataFrame([("aa bb", 1), ("aa aa cc", 0)] * 3, "text string, label int")
    w = tm.Weights.fit(df, "text")
    diff = tm.class_differences(df, w, "text").checkpoint()
    rows = spark.createDataFrame([(1, "bb aa bb"), (2, "zz"), (3, None), (4, "cc")], "k int, text string")
    told = tm.score_by_terms(rows, "text", diff, ["k"], w)
    known = {r.term: r.diff for r in diff.collect()}
    got = {r.k: (r.matched, r.avg_score) for r in told.collect()}
    assert got == {1: (3, pytest.approx((known["aa"] + known["bb"] + known["aa bb"]) / 3)), 4: (1, pytest.approx(known["cc"]))}
    assert "Exchange" not in told._jdf.queryExecution().executedPlan().toString()
    assert tm.score_by_terms(rows, "text", diff.limit(0), ["k"], w).count() == 0


def test_tfidf_weights(spark):
    docs = [("aa bb", 1), ("aa aa cc", 0), ("", 0), (None, 1)]
    df = spark.createDataFrame(docs, "text string, label int")
    w = tm.Weights.fit(df, "text")
    idf = dict(zip(w.terms, w.idf))
    assert idf["aa"] == pytest.approx(math.log(5 / 3) + 1) and idf["bb"] == pytest.approx(math.log(5 / 2) + 1)
    diff = {r.term: r for r in tm.class_differences(df, w, "text").collect()}
    norm = math.sqrt(idf["aa"] ** 2 + 2 * idf["bb"] ** 2)
    assert diff["bb"].phishing == pytest.approx(idf["bb"] / norm / 2) and diff["bb"].legitimate == 0
    told = tm.score_by_terms(df.withColumn("k", F.lit(1)), "text", tm.class_differences(df, w, "text"), ["text"], w)
    assert {r.text: r.verdict for r in told.collect()} == {"aa bb": "SUSPICIOUS", "aa aa cc": "LIKELY SAFE"}


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(1003).select("id", (F.col("id") % 10 < 3).cast("int").alias("label"))
    def split():
        return tr.stratified_split(df, "label", F.xxhash64("id", F.lit(42)), tie=[F.col("id")])

    got = {r.label: (r.n, r.t) for r in split().groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert got == {1: (303, 61), 0: (700, 140)}
    assert {r.id for r in split().where("is_test").collect()} == {r.id for r in split().where("is_test").collect()}


def test_trust_list_as_table(spark):
    domains = spark.createDataFrame([("a.b.com",), ("A.B.com",), ("xb.com",), ("b.com",), ("com",)], "domain string")
    got = {r.domain: (r.n, r.is_trusted) for r in trust.domain_trust(domains, spark.createDataFrame([("B.com",)], "domain string")).collect()}
    assert got == {"a.b.com": (2, True), "xb.com": (1, False), "b.com": (1, True), "com": (1, False)}


def test_rules_and_quarantine(spark):
    df = spark.createDataFrame([(1, 0, -1, 1.5), (0, 2, 3, 0.5), (None, 1, 0, None)],
                               "has_attachment int, urgent_keywords int, links_count int, probability double")
    assert {r.rule: (r.checked, r.violations) for r in quality.rule_counts(df).collect()} == {
        "has_attachment": (2, 0), "urgent_keywords": (3, 1), "links_count": (3, 1), "probability": (2, 1)}
    broken = sorted(r.b for r in df.select(quality.broken_rules(df).alias("b")).collect())
    assert broken == [[], ["links_count", "probability"], ["urgent_keywords"]]


@few
@given(st.floats(0, 1), st.integers(0, 1), st.integers(0, 20), st.sampled_from(["linkedin.com", "evil.xyz", "unknown", "bank.biz"]),
       st.lists(st.sampled_from(["linkedin.com", "x.evil.top", "mail.google.com"]), max_size=4, unique=True))
def test_score_properties(spark, p, urgent, links, sender, domains):
    schema = "probability double, urgent_keywords int, links_count int, sender_domain string, link_domains array<string>"
    rows = [(p, urgent, links, s, d) for s in (sender, "linkedin.com") for d in (domains, ["linkedin.com"])]
    scores = [r.ensemble_score for r in scoring.add_risks(spark.createDataFrame(rows, schema)).collect()]
    assert all(0 <= s <= 1 for s in scores)
    assert scores[2] <= scores[0] + 1e-12  # a trusted sender never raises the score


@pytest.fixture(scope="module")
def trained(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(160):
        bad = i % 2
        words = ["verify", "account", "prize"] if bad else ["meeting", "agenda", "report"]
        rows.append((i, " ".join(rnd.choices(words + ["filler", "other"], k=12)), "spam" if bad else "ham", f"set{i % 3}"))
    history = spark.createDataFrame(rows, "id bigint, Body string, `Class ` string, origin string")
    train_rows = tr.training_rows(history, "body", keep=("id", "origin"))
    return tr.train(train_rows, tr.Settings(rounds=3, depth=3, vocabulary=40), "v7", dataset="origin", row_id="id")


def test_training(spark, trained, tmp_path):
    report = {r["class"]: r for r in trained.report.collect()}
    assert report["weighted avg"].f1 > 0.95 and report["accuracy"].support == 32
    s = trained.summary.first()
    assert (s.num_datasets, s.num_samples, s.label_distribution) == (3, 160, {"0": 80, "1": 80})
    assert s.feature_cols == c.FEATURE_COLUMNS and s.optimal_threshold == trained.model.threshold


def test_model_round_trip_and_scoring(spark, trained, tmp_path):
    trained.model.save(spark, str(tmp_path / "model"))
    back = tr.TrainedModel.load(spark, str(tmp_path / "model"))
    assert (back.threshold, back.margin, back.version) == (trained.model.threshold, 0.2, "v7")
    emails = spark.createDataFrame([(1, "verify account prize verify"), (2, "meeting agenda report")], "email_id bigint, text string")
    got = {r.email_id: r for r in score_table(emails, back).collect()}
    assert got[1].probability > 0.5 > got[2].probability
    assert got[2].classification == "LEGITIMATE" and got[1].prediction == 1


def test_bulk_run(spark, trained):
    emails = spark.createDataFrame([(1, 10, "verify account prize"), (2, 20, "meeting agenda")], "email_id bigint, user_id bigint, body string")
    asked = spark.createDataFrame([(100, 1, 10), (101, 1, 10), (102, 2, 10), (103, 9, 10)], "request_id bigint, email_id bigint, user_id bigint")
    records, outcome = score_module.analyze_requests(asked, emails, trained.model)
    got = records.collect()
    assert [(r.email_id, r.prediction) for r in got] == [(1, 1), (1, 1)] and len({r.prediction_key for r in got}) == 2
    assert tuple(scoring.outcome_counts(outcome).first()) == (4, 2, 2)


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    emails = spark.range(100).withColumnRenamed("id", "email_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("bucketed_emails", "bucketed_predictions"):
            sinks.write_bucketed(emails, name, "email_id", 4, str(tmp_path / name))
        joined = spark.table("bucketed_emails").join(spark.table("bucketed_predictions"), "email_id")
        assert joined.count() == 100
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_saved_model_defaults(spark, trained, tmp_path):
    trained.model.save(spark, str(tmp_path / "model"))
    spark.createDataFrame([("x",)], "other string").write.mode("overwrite").json(str(tmp_path / "model" / "params"))
    back = tr.TrainedModel.load(spark, str(tmp_path / "model"))
    assert (back.threshold, back.margin, back.version) == (0.5, 0.2, "unknown")


@pytest.mark.parametrize("domains", [1, 2, 20])
def test_every_domain_has_its_column(spark, domains):
    rows = [(i % 2, f"word{i % 3} text", 0, i, 0, 5, 0, f"d{i % domains}.com") for i in range(20)]
    df = spark.createDataFrame(rows, "label int, text string, has_attachment int, links_count int, urgent_keywords int, "
                                     "body_length int, exclamation_count int, sender_domain string")
    _, out = tr.fit_features(df, tr.Settings(vocabulary=10))
    assert out.first().features.size == 7 + 5 + domains  # 4 words, 3 pairs


def test_trees_read_rows_dealt_evenly(spark, monkeypatch):
    """Every task sums up all bins, so the trees get a task for each core, of equal size, however the rows lie."""
    seen = []

    class Stop(Exception):
        pass

    class Trees:
        def __init__(self, **_):
            pass

        def fit(self, rows):
            seen.append((rows.rdd.glom().map(len).collect(), Counter((r.label, tuple(r.features.toArray())) for r in rows.collect())))
            raise Stop

    columns = ("cast(id % 2 as int) AS label", "concat('word', id % 3, ' text') AS text", "0 AS has_attachment", "id AS links_count",
               "0 AS urgent_keywords", "5 AS body_length", "0 AS exclamation_count", "concat('d', id % 4, '.com') AS sender_domain")
    ends = spark.range(0, 400, 1, 1).selectExpr(*columns).unionByName(spark.range(400, 440, 1, 20).selectExpr(*columns))  # 21 partitions, one of them large
    monkeypatch.setattr(tr, "GBTClassifier", Trees)
    cores = spark.sparkContext.defaultParallelism
    wanted = Counter((r.label, tuple(r.features.toArray())) for r in tr.fit_features(ends, tr.Settings(vocabulary=10))[1].collect())
    for settled, tasks in ((tr.TASK_BYTES, cores), (16 * 4 * 30, 2 * cores)):  # 16 columns; 30 rows a task at most
        monkeypatch.setattr(tr, "TASK_BYTES", settled)
        with pytest.raises(Stop):
            tr.fit_model(ends, tr.Settings(vocabulary=10))
        sizes, rows = seen.pop()
        assert len(sizes) == tasks and rows == wanted
        assert max(sizes) <= 2 * 440 / tasks


def test_few_rows_do_not_go_to_many_tasks(spark, monkeypatch):
    """On many cores a task has LEAST_ROWS rows or more, once there are FEW_TASKS."""
    rows = tr.fit_features(
        spark.createDataFrame([(i % 2, "some text", 0, i, 0, 5, 0, "a.com") for i in range(40)],
                              "label int, text string, " + ", ".join(f"{n} int" for n in c.FEATURE_NUMERIC) + ", sender_domain string"),
        tr.Settings(vocabulary=10))[1]
    monkeypatch.setattr(tr, "FEW_TASKS", 2)
    monkeypatch.setattr(tr, "LEAST_ROWS", 10)
    assert [tr.dealt_for_trees(rows, n).rdd.getNumPartitions() for n in (0, 10, 40, 4000)] == [2, 2, 4, spark.sparkContext.defaultParallelism]


def test_quarantined_training_rows(spark):
    df = spark.createDataFrame([("t", "spam"), ("u", "2"), (None, "ham")], "text string, label string")
    assert tr.training_rows(df, "text", strict=False).count() == 1
    with pytest.raises(Exception, match="unknown label"):
        tr.training_rows(df, "text").collect()


def test_deep_pages(spark):
    df = spark.range(6000).select(
        F.col("id").alias("email_id"),
        (F.col("id") % 2).alias("user_id"),
        F.timestamp_add("MINUTE", F.col("id"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("received_at"),
    )
    got = store.email_pages(df, limit=10, offset=2000).where("user_id = 0").orderBy("position").collect()
    assert [r.email_id for r in got] == [5998 - 2 * (2000 + i) for i in range(10)]
    with pytest.raises(ValueError):
        store.email_pages(df, limit=10_000)


def test_resolve_with_nulls_and_stored_rows(spark):
    schema = "email_id long, user_id long, message_id string"
    incoming = spark.createDataFrame([(1, 7, "a"), (2, 7, "a"), (3, None, "b"), (4, 7, None)], schema)
    stored = spark.createDataFrame([(90, 7, "a"), (91, 8, "z"), (92, 7, None)], schema)
    got = store.resolve_insert(incoming, stored).select("email_id", "stored_email_id").collect()
    assert sorted(map(tuple, got)) == [(1, 90), (2, 90), (3, 3), (4, 92)]


def test_row_delivered_twice(spark):
    rows = spark.createDataFrame([(3, 7, "k"), (3, 7, "k"), (5, 7, "k"), (6, None, "k")], "email_id long, user_id long, message_id string")
    assert sorted(r.email_id for r in store.first_arrivals(rows).collect()) == [3, 6]


def test_registered_training_takes_the_defaults(spark, sf, monkeypatch):
    """The registered queries fit features and trees with the default settings, nothing smaller."""
    from mailscore.plans import queries_model

    seen = []

    class Stop(Exception):
        pass

    def stop(rows, settings=None, **_):
        seen.append(settings or tr.Settings())
        raise Stop

    monkeypatch.setattr(queries_model.tr, "train", stop)
    monkeypatch.setattr(queries_model.tr, "fit_features", stop)
    for query in (queries_model.feature_vectors, queries_model.boosted_trees, queries_model.batch_probability):
        with pytest.raises(Stop):
            query(spark, sf)
    assert seen == [tr.Settings()] * 3
