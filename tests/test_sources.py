"""Readers, sinks, dataset memory and message payloads."""

import base64
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from mailscore.operators import schema
from mailscore.sources import memory, messages, readers, records, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_semicolons_quotes_and_line_breaks(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('Body;Label\n"a; ""b""\nc";1\nshort\nlong;1;2;3\nx;0\n', encoding="utf-8")
    layout = readers.layout_of(spark, str(p))
    assert (layout.sep, layout.columns, layout.utf8) == (";", ("Body", "Label"), True)
    good, bad = readers.read_delimited(spark, str(p), layout)
    assert set(rows(good.fillna("-"))) == {('a; "b"\nc', "1"), ("short", "-"), ("x", "0")}
    assert bad.count() == 1
    assert readers.read_dataset(spark, str(p)).columns == ["Body", "Label"]


def test_encodings(spark, tmp_path):
    for name, encoding in [("u.csv", "utf-8"), ("l.csv", "latin1")]:
        p = tmp_path / name
        p.write_bytes("body,label\ncafé à la,1\n".encode(encoding))
        assert rows(readers.read_dataset(spark, str(p))) == [("café à la", "1")]
        assert readers.layout_of(spark, str(p)).utf8 is (encoding == "utf-8")


def test_tabs_and_unknown_type(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text("body\tlabel\nx, y\t1\n")
    assert rows(readers.read_dataset(spark, str(p))) == [("x, y", "1")]
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_dataset(spark, str(tmp_path / "a.bin"))


def test_json_lines_and_array(spark, tmp_path):
    data = [{"body": "x", "label": 1}, {"body": "y", "label": 0}]
    lines, array = tmp_path / "l.json", tmp_path / "a.json"
    lines.write_text("\n".join(json.dumps(d) for d in data))
    array.write_text(json.dumps(data, indent=1))
    assert rows(readers.read_json(spark, str(lines))) == rows(readers.read_json(spark, str(array))) == [("x", "1"), ("y", "0")]


def test_discovery(spark, tmp_path):
    for name in ["a.csv", "deep/b.JSON", "deep/c.bin", "history/d.csv", "noext"]:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    found = readers.list_dataset_files(spark, str(tmp_path), (str(tmp_path / "history"),))
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["a.csv", "b.JSON"]


def test_raw_email_drops_bad_bytes(spark, tmp_path):
    (tmp_path / "m.txt").write_bytes(b"caf\xc3\xa9 \xff\xfeok")
    assert readers.read_raw_emails(spark, str(tmp_path), "*.txt").first().text == "café ok"


def test_quoted_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('a "q", b\nc', "1"), ("plain", "0")], "body string, label string")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "out"), quote_all=True)
    part = next((tmp_path / "out").glob("*.csv"))
    assert part.read_text().startswith('"body","label"')
    assert rows(readers.read_quoted(spark, str(part))) == rows(df)


def test_file_fingerprint(spark, tmp_path):
    lines = [f"row {i % 7}" for i in range(5000)]
    p, q, r, e = (tmp_path / n for n in ("p.csv", "q.csv", "r.csv", "e.csv"))
    p.write_text("\n".join(lines) + "\n")
    q.write_text("\n".join(reversed(lines)) + "\n")
    r.write_bytes(p.read_bytes())
    e.write_bytes(b"")
    paths = [str(x) for x in (p, q, r, e)]

    def prints():
        return {x.path.rsplit("/")[-1]: x.fingerprint for x in memory.file_fingerprints(spark, paths).collect()}

    whole = prints()
    assert whole["p.csv"] == whole["r.csv"] != whole["q.csv"] and set(whole) == {"p.csv", "q.csv", "r.csv"}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # many splits, same digest
    try:
        assert prints() == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    head = memory.file_fingerprints(spark, [str(p)], head_bytes=4).first().fingerprint
    assert head == hashlib.sha256(p.read_bytes()[:4]).hexdigest()[:16]


def test_dataset_memory(spark, tmp_path):
    incoming = tmp_path / "incoming"
    incoming.mkdir()
    (incoming / "a.csv").write_text("Body,Label\nx,1\ny,0\n")
    (incoming / "b.csv").write_text("Body,Label\nz,0\n")
    (incoming / "c.json").write_text('{"body": "j", "kind": "spam"}\n')
    (incoming / "copy.csv").write_text("Body,Label\nx,1\ny,0\n")
    files = [str(p) for p in sorted(incoming.iterdir())]
    store = memory.DatasetMemory(spark, str(tmp_path / "history"))
    first = store.cache(files)
    assert sorted(first.values()) == ["[CACHE]"] * 3 + ["[SKIP]"]
    assert set(store.cache(files).values()) == {"[SKIP]"}
    df = store.load()
    assert set(df.columns) == {"body", "label", "kind", "dataset_hash"}
    assert rows(df.select("body").na.fill("")) == [("j",), ("x",), ("y",), ("z",)]
    assert df.where("label is null").count() == 1
    assert df.select("dataset_hash").distinct().count() == 3


def test_empty_memory(spark, tmp_path):
    with pytest.raises(RuntimeError):
        memory.DatasetMemory(spark, str(tmp_path)).load()


def b64(text):
    return base64.urlsafe_b64encode(text.encode()).decode()


def message(**payload):
    headers = payload.pop("headers", {})
    payload["headers"] = [{"name": k, "value": v} for k, v in headers.items()]
    return json.dumps({"id": payload.pop("id", "m"), "payload": payload})


def part(kind, text):
    return {"mimeType": kind, "body": {"data": b64(text)}}


def flat(spark, *docs):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "n int, payload_json string")
    return messages.flatten_messages(df, keep=("n",)).orderBy("n").collect()


def test_mime_bodies(spark):
    plain_then_html = message(mimeType="multipart/mixed", parts=[part("text/plain", "ü>?"), part("text/html", "<b>")])
    html_then_plain = message(mimeType="multipart/mixed", parts=[part("text/html", "<b>"), part("text/plain", "t")])
    two_html = message(mimeType="multipart/mixed", parts=[part("text/html", "1"), part("text/html", "2")])
    single = message(mimeType="text/plain", body={"data": b64("one")})
    single_html = message(mimeType="text/html", body={"data": b64("<i>")})
    nested = message(mimeType="multipart/mixed", parts=[{"mimeType": "multipart/alternative", "parts": [part("text/plain", "in")]}])
    got = flat(spark, plain_then_html, html_then_plain, two_html, single, single_html, nested)
    assert [r.body for r in got] == ["ü>?", "<b>t", "1", "one", "", ""]


def test_headers_dates_and_rejects(spark):
    ok = message(mimeType="text/plain", body={}, headers={"Subject": "s", "From": "a@b.c", "Date": "Sat, 25 Jan 2026 10:00:00 +0700"})
    twice = json.dumps({"id": "t", "payload": {"mimeType": "text/plain", "body": {}, "headers": [
        {"name": "Subject", "value": "old"}, {"name": "Subject", "value": "new"}]}})
    bad = message(mimeType="text/plain", body={"data": "YWJjZ"})
    typeless = message(mimeType="multipart/mixed", parts=[{"body": {"data": b64("x")}}])
    noise = message(mimeType="text/plain", body={"data": "Y%W\nJj"}, headers={"Date": "5 Feb 2024 07:30 EST"})
    got = flat(spark, ok, twice, bad, "not json", typeless, noise)
    assert (got[0].subject, got[0].sender, got[0].recipient, got[0].body) == ("s", "a@b.c", "", "")
    assert got[0].received_at.isoformat() == "2026-01-25T03:00:00"
    assert got[1].subject == "new" and got[1].received_at is not None
    assert [r.reject is None for r in got] == [True, True, False, False, False, True]
    assert got[5].body == "abc" and got[5].received_at.isoformat() == "2024-02-05T12:30:00"
    good, rejected = messages.split_rejects(messages.flatten_messages(spark.createDataFrame([(bad,), (ok,)], "payload_json string")))
    assert (good.count(), rejected.count()) == (1, 1)


def test_ad_hoc_ids_do_not_collide(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "x")], "user_id int, text string")
    out = messages.ad_hoc_emails(df)
    assert out.count() == 3 and out.select("message_id").distinct().count() == 3


def test_column_resolution(spark):
    df = schema.normalize_columns(spark.createDataFrame([("s", "t", 1)], "` Subject` string, Email_Text string, `Type ` int"))
    assert df.columns == ["subject", "email_text", "type"]
    assert df.select(schema.text_expression(df, "body").alias("t")).first().t == "s t"
    assert df.select(schema.text_expression(df, "Subject").alias("t")).first().t == "s"
    assert schema.label_column(df, "verdict") == "type"
    with pytest.raises(KeyError):
        schema.label_column(df.drop("type"))
    with pytest.raises(KeyError):
        schema.text_expression(df.select("type"))


def test_auto_detection_by_name_and_errors(spark):
    df = spark.createDataFrame([("long text here", "x", 1)], "text string, kind string, spam int")
    assert schema.auto_detect(df) == ("text", "spam")
    assert schema.auto_detect(df, "kind", "text") == ("kind", "text")
    with pytest.raises(ValueError):
        schema.auto_detect(df.select(F.col("spam").alias("n")))


def test_metadata_and_prediction_sink(spark, tmp_path):
    sinks.write_metadata(spark.createDataFrame([(1, 0.5)], "num_samples int, optimal_threshold double"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().optimal_threshold == 0.5
    scored = spark.createDataFrame([(7, 1, 0.9)], "email_id bigint, prediction int, probability double")
    for _ in range(2):
        sinks.append_predictions(sinks.prediction_records(scored, "v1"), str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 2 and back.select("prediction_key").distinct().count() == 1


SEPS = [",", ";", "\t", "|"]


def random_file(draw, sep):
    """Quoted and bare fields with separators, quotes and line breaks in them; rows of several widths."""
    atoms = ["a", "b", '"', '""', sep, "\n", "x y", "", " ", "é", "1"]

    def one():
        raw, kind = "".join(draw.choice(atoms) for _ in range(draw.randint(0, 9))), draw.random()
        if kind < 0.55:
            return '"' + raw.replace('"', '""') + '"'
        bare = raw.replace('"', "").replace("\n", "").replace(sep, "")
        return bare if kind < 0.93 else f'a{bare}"z'  # a quote inside a bare field opens nothing

    rows_ = [sep.join(one() for _ in range(draw.choice([3, 3, 3, 2, 4]))) for _ in range(250)]
    return "\n".join([sep.join(["body", "label", "third"]), *rows_]) + draw.choice(["", "\n", f'\n"open {sep} x\ny'])


@pytest.mark.parametrize("seed", range(3))
def test_cut_files_are_read_as_whole_ones(spark, tmp_path, seed):
    draw = random.Random(seed)
    sep, encoding = SEPS[seed], ["utf-8", "ISO-8859-1"][seed % 2]
    p = tmp_path / "f.csv"
    p.write_text(random_file(draw, sep), encoding=encoding)
    reader = spark.read.schema("a string, b string, c string, d string").option("sep", sep).option("header", "true")
    whole = reader.option("multiLine", "true").option("escape", '"').option("encoding", encoding).csv(str(p)).collect()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        assert records.numbered_lines(spark, str(p)).select("block").distinct().count() > 5
        good, bad = readers.read_delimited(spark, str(p), readers.Layout(sep, ("a", "b", "c"), encoding == "utf-8"))
        got, n_bad = good.collect(), bad.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got), key=repr) == sorted((tuple(r[:3]) for r in whole if r.d is None), key=repr)
    assert n_bad == sum(r.d is not None for r in whole) > 10


def test_intake_of_every_form_at_once(spark, tmp_path):
    folder = tmp_path / "in folder"
    folder.mkdir()
    (folder / "semi.csv").write_text('Body;Label;Body\n"a; b\nc";1;x\ntoo;many;fields;here\n')
    (folder / "latin.txt").write_bytes("body|kind\ncafé|spam\n".encode("latin1"))
    (folder / "lines.json").write_text('{"Body": "j", "n": 1.5, "deep": {"a": [1]}}\nnot json\n\n{"body": null}\n')
    (folder / "array.json").write_text('\n [{"body": "k"},\n {"body": "l", "n": true}]')
    (folder / "broken.json").write_text('[{"body": "k"},')
    (folder / "header.csv").write_text("body,label\n")
    (folder / "empty.csv").write_text("")
    store = memory.DatasetMemory(spark, str(tmp_path / "history"))
    files = [str(p) for p in sorted(folder.iterdir())]
    outcome = {r.source.rsplit("/")[-1]: (r.status, r.n_rows, r.n_rejected) for r in store.intake(files).collect()}
    assert outcome == {
        "semi.csv": ("[CACHE]", 1, 1), "latin.txt": ("[CACHE]", 1, 0), "lines.json": ("[CACHE]", 2, 1),
        "array.json": ("[CACHE]", 2, 0), "broken.json": ("[CACHE]", 0, 1), "header.csv": ("[CACHE]", 0, 0),
    }
    df = store.load()
    assert set(df.columns) == {"body", "label", "body_3", "kind", "n", "deep", "dataset_hash"}
    assert set(rows(df.select("body", "n", "deep").fillna("-"))) == {
        ("a; b\nc", "-", "-"), ("café", "-", "-"), ("j", "1.5", '{"a":[1]}'), ("-", "-", "-"), ("k", "-", "-"), ("l", "true", "-"),
    }
    assert {r._bad_row for r in store.rejected().collect()} == {"too;many;fields;here", "not json", '[{"body": "k"},'}
    assert {r.status for r in store.intake(files).collect()} == {"[SKIP]"}
    assert store.load().count() == df.count()


def test_jobs_do_not_grow_with_the_files(spark, tmp_path):
    def jobs(n, name):
        folder = tmp_path / name
        folder.mkdir()
        for i in range(n):
            kind = i % 3
            (folder / f"{i}.{['csv', 'txt', 'json'][kind]}").write_text([f"body,x{i}\n{name},{i}\n", f"body;y{i}\n{name};{i}\n", f'{{"body": "{i}{name}"}}\n'][kind])
        group = f"intake-{name}"
        spark.sparkContext.setJobGroup(group, name)
        memory.DatasetMemory(spark, str(tmp_path / f"h-{name}")).cache([str(p) for p in folder.iterdir()])
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, many = jobs(3, "few"), jobs(60, "many")
    assert many <= few + 4  # adaptive execution may start a stage of its own here or there


def test_other_line_ends_are_another_file(spark, tmp_path):
    for name, end in [("a.csv", "\n"), ("b.csv", "\r\n"), ("c.csv", "\n")]:
        (tmp_path / name).write_bytes(end.join(["body,label", "x,1", ""]).encode())
    found = {r.path.rsplit("/")[-1]: r.fingerprint for r in memory.file_fingerprints(spark, str(tmp_path)).collect()}
    assert found["a.csv"] == found["c.csv"] != found["b.csv"]


def test_raw_messages_lie_in_few_folders(spark, tmp_path):
    rows = [(i, f"From: a@b.c\n\nmail {i} ü") for i in range(900)] + [(5, "copy"), (1000, None), (1001, "")]
    path = str(tmp_path / "raw mail")
    sinks.write_raw_messages(spark.createDataFrame(rows, "doc_id long, text string"), path, "doc_id", "text")
    assert len([p for p in os.listdir(path) if not p.startswith((".", "_"))]) <= sinks.RAW_FOLDERS  # not one for each message
    mails = readers.read_raw_emails(spark, f"{path}/*")
    got = {int(r.path.rpartition("doc_id=")[2]): r.text for r in mails.collect()}
    want = {i: f"{t or ''}\n" for i, t in rows if i != 5}
    assert sorted(got.pop(5).split("\n")) == sorted(f"{rows[5][1]}\ncopy\n".split("\n"))
    assert {i: got[i] for i in want if i != 5} == want and len(got) == len(want)
    sinks.write_raw_messages(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"), "doc_id", "text")
    assert readers.read_raw_emails(spark, f"{tmp_path}/none/*").count() == 0


def test_raw_messages_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Before: the driver held the names of all messages."""
    folder = tmp_path / "raw mail"
    files = {"1/doc_id=1": b"one", "1/doc_id=2": b"caf\xc3\xa9 \xff", "2/a%2Fb": b"", "2/_hidden": b"x", "2/.crc": b"x", "2/_k=1": b"y", "2/deep/no": b"x", "2/k=3/in": b"z", "top": b"t", "_SUCCESS": b""}
    for name, content in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(content)
    monkeypatch.setattr(readers, "FILES_AT_ONCE", 2)
    mails = readers.read_raw_emails(spark, f"{folder}/*")
    assert {r.path: r.text for r in mails.collect()} == {
        f"file:{folder}/{k}": v for k, v in (("1/doc_id=1", "one"), ("1/doc_id=2", "café "), ("2/a%2Fb", ""), ("2/_k=1", "y"), ("2/k=3/in", "z"), ("top", "t"))
    }
    assert not mails.inputFiles()  # no list of files in the driver
    plain = readers.read_raw_emails(spark, f"file://{folder}/1", "*{=2,9}")
    assert [(r.path, r.text) for r in plain.collect()] == [(f"file:{folder}/1/doc_id=2", "café ")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_raw_emails(spark, str(tmp_path / "absent"))
