"""Registered queries: names, plans, and results against the other engine on the smallest tables."""

import glob
import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of

COMPARED = [
    "src8_dataset_memory", "src13_flatten_messages", "src14_keyed_insert", "prj4_auto_detect", "prj7_overrides",
    "sc19_score_record", "sc23_segment_reasons", "wn2_prediction_history", "jn4_orphan_predictions", "ag6_length_crosstab",
    "src1_tolerant_read", "src3_json_forms", "src8_file_intake", "src9_history_files", "src16_model_version", "prj3_label_column",
    "ag12_dashboard", "ag13_classification_report", "tk1_indicator_terms", "sc25_score_by_terms",
]
# these run jobs while they are planned
EAGER = re.compile("^(ml|st[123]_|ag16|ag17|tk1|sc25|src[1-6]_|src8_file|src9_history_files|src1[0126]_)")


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", COMPARED)
def test_equal_results(spark, sf, db, name):
    df = entry.queries()[name](spark, sf)
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_imports_without_the_optional_part(tmp_path, gone):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("mailscore", "__spark_entry__.py", "corpus_pipeline.py"):
        here, there = os.path.join(root, name), tmp_path / name
        if os.path.isdir(here):
            shutil.copytree(here, there, ignore=shutil.ignore_patterns(*gone, "__pycache__"))
        elif name not in gone and os.path.exists(here):
            shutil.copy(here, there)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op1') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 200 and "ensemble_score" in df.columns


def test_no_pairwise_joins_and_no_python(spark, sf):
    bad = []
    for name, run in entry.queries().items():
        if EAGER.match(name):
            continue
        plan = run(spark, sf)._jdf.queryExecution().executedPlan().toString()
        bad += [(name, x) for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython") if x in plan]
    assert bad == []


def test_only_needed_columns_are_read(spark, sf):
    plan = entry.queries()["wn2_prediction_history"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    # the count of the emails reads no column
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == {"event_id:bigint,ts:timestamp_ntz", ""}
    plan = entry.queries()["src14_first_arrivals"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan


def test_every_email_is_scored_or_said_not_to_be(spark):
    sf = "/root/testdata/sf0.1"
    rows = entry.queries()["sc19_score_record"](spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    found = {r["classification"]: r["count"] for r in rows.groupBy("classification").count().collect()}
    assert sum(found.values()) == n and found["NOT_SCORED"] == n // 20
