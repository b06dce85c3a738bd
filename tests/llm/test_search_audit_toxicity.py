"""Lexical search, filter audit and toxicity against plain Python: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailscore.llm import filter_audit, lexical_search, queries, toxicity
from mailscore.llm.blocks import importable, terms_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank string, part int, mask string, label string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "the of AND Stone river ÜBER straße ça 12 x y it's #tag a&b river-bed q z".split()


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(11)
    out = [" ".join(draw.choice(WORDS) for _ in range(draw.randint(1, 60))) for _ in range(90)]
    out += [" ".join(draw.choice(WORDS) + str(i % 400) for i in range(30_000)), "", None, " \n ", "###", out[3], out[3], "STONE", "stone", "one " * 200]
    return [*enumerate(out), (5, out[5]), (7, "another text of seven"), (None, out[3]), (None, "stone river")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    importable(spark)
    langs = ["en", "de", None, "fr"]
    rows = [(i, t, langs[n % 4], "s", 1, 0.5, "r", 1, "m", "l") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def labels(spark, texts):
    rows = [(i, i % 3 % 2, i % 4 // 3, "x") for i, _ in texts if i is not None and i % 5]
    rows += [(2, 1, 1, "again"), (None, 1, 1, ""), (4, None, None, ""), (900, 1, 1, "no such document")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


ITEMS = [
    (1, "the stone, the river"), (1, "the stone, the river"), (2, "ÜBER über straße"), (3, None), (4, ""), (5, "absent words only"),
    (6, " ".join(WORDS)), (None, "river 12"), (7, "stone " * 50), (8, "STONE3 the399 x7"),
]


def ranked(texts, items, top):
    """The contract, a document at a time."""
    of = [(i, Counter(TERM.findall(t.translate(LOWER)))) for i, t in texts if t is not None]
    of = [(i, c) for i, c in of if c]
    total, length, held = len(of), sum(sum(c.values()) for _, c in of), Counter(t for _, c in of for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        query, found = TERM.findall((text or "").translate(LOWER)), []
        for i, c in of:
            m = 25 + 75 * sum(c.values()) * total // length
            weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * held[t] + 1))) for t in query}
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in query)
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("top", "block", "exact"), [(10, 400_000, 1 << 53), (3, 4, 1 << 53), (5, 400_000, 40_000_000_000)])
def test_search(spark, docs, texts, monkeypatch, top, block, exact):
    monkeypatch.setattr(lexical_search, "EXACT", exact)  # a small bound cuts weights over many tiles
    monkeypatch.setattr(lexical_search, "TILE_DOCS", 17)
    monkeypatch.setattr(lexical_search, "TILE_QUERIES", 3)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, rank int")
    got = lexical_search.search(docs, items, top, block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(texts, ITEMS, top)


def test_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame([(i, t) for i, t in ITEMS], "item_id long, text string")
    assert lexical_search.search(docs, items.limit(0)).collect() == []
    assert lexical_search.search(docs.limit(0), items).collect() == []
    assert lexical_search.search(docs, items.where("item_id IN (3, 4)")).collect() == []


def test_tiles_stay_exact(monkeypatch):
    monkeypatch.setattr(lexical_search, "EXACT", 1000 * lexical_search.IMPACT)
    asked = [Counter({0: 3, 1: 1, 5: 900}), Counter({1: 2, 5: 1}), Counter()]
    weights = np.array([100, 7, 0, 0, 0, 5])
    cut = lexical_search.tiles(asked, weights, tall=2, widest=2)
    total = Counter()
    for tile in cut:
        sums = Counter()
        for q, k, w in zip(tile.query.tolist(), tile.column.tolist(), tile.weight.tolist(), strict=True):
            sums[q] += w
            total[q + tile.first, int(tile.terms[k])] += w
        assert max(sums.values()) < 1000 and len(set(tile.terms.tolist())) == len(tile.terms) <= 2
    assert total == {(q, t): n * int(weights[t]) for q, c in enumerate(asked) for t, n in c.items()}


def audited(rows, labels):
    """Every order applied in turn, a document at a time."""
    good, bad = ({i for i, q, t, _ in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    judged = []
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and first[t] < i,
        }
        judged.append((part or "", fails, i in good, i in bad))
    out = []
    for part in {p for p, *_ in judged}:
        mine, sums, made = [x for x in judged if x[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                fails = [x for x in mine if x[1][f]]
                alone = [x for x in fails if sum(x[1].values()) == 1]
                sums[f] += len(gone)
                made.append((part, "".join(order), step, len(left), len(gone), len(fails) - len(gone), len(alone), sum(x[2] for x in gone), sum(x[3] for x in gone), f))
        out += [(*x[:-1], sums[x[-1]]) for x in made]
    return sorted(out)


def test_audit(docs, labels):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    got = filter_audit.audit(docs, labels)
    assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert sorted(map(tuple, got.collect())) == audited(rows, [tuple(r) for r in labels.collect()])
    assert filter_audit.audit(docs.limit(0), labels).collect() == []
    plain = filter_audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first()
    assert tuple(plain) == (0, 0, 4 * 600)


def test_every_mask_is_removed_once_in_every_order():
    covered = Counter((m, rank) for m, _, lo, hi in filter_audit.intervals() for rank in range(lo, hi))
    assert covered == {(m, rank): 1 for m in range(1, 32) for rank in range(120)}


def test_own_failures():
    assert filter_audit.own_failures(b"") == 1
    assert filter_audit.own_failures(b"x " * 200) == 2
    assert filter_audit.own_failures(" ".join(map(str, range(200))).encode()) == 0
    text = ("É" * 97 + "ABC").encode()  # 3 capitals of 100 code points are not over 3 %
    assert filter_audit.own_failures(text) == 1 and filter_audit.own_failures(text + b"D") == 1 | 4
    assert filter_audit.own_failures(b"a|b") == 1 | 8


def test_nearest_examples_are_the_exact_ones(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    draw = np.random.default_rng(3)
    idf = 1 + draw.random(30)

    def vector():
        terms = np.sort(draw.choice(30, draw.integers(0, 6), replace=False)).astype(np.int32)
        return terms.tobytes(), draw.integers(1, 5, len(terms)).astype(np.int32).tobytes()

    examples = [(i, int(i % 3 == 0), *vector()) for i in range(150)]
    examples += [(200 + i, 1, *examples[7][2:]) for i in range(40)]  # ties
    index, held = toxicity.build(examples, idf)
    asked = [vector() for _ in range(60)] + held[:20]
    rows, all_ = index.rows(asked), index.rows(held)
    but = np.array([-1] * 60 + list(range(20)))
    number, near = index.nearest(rows, 9, but)
    exact = (rows @ all_.T).astype(np.int64)
    for q in range(len(asked)):
        want = sorted((-s, n) for n, s in enumerate(exact[q].tolist()) if s > 0 and n != but[q])[:9]
        got = [(-s, n) for n, s in zip(number[q].tolist(), near[q].tolist(), strict=True) if n >= 0]
        assert got == want
    assert ((rows * rows).sum(axis=1) < 1.001 * toxicity.SCALE**2).all()


def test_toxicity(spark, docs, labels, sf):
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    for none in (labels.limit(0), labels.select("doc_id", F.lit(None).cast("int").alias("toxic"))):
        assert {(r.score, r.predicted) for r in toxicity.toxicity(docs, none).collect()} == {(0.0, 0)}
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    scored = queries.QUERIES["op11_toxicity"](spark, folder)
    known = scored.where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in known.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.8 * (n[1, 1] + n[1, 0])
    assert n[0, 1] <= 0.02 * (n[0, 1] + n[0, 0])


def test_labels_of_held_out_documents_are_not_used(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    importable(spark)
    other = labels.withColumn("toxic", F.when(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    moved = docs.select((F.col("doc_id")).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("yy").alias("source"))
    one, two = (toxicity.toxicity(d, x).select("doc_id", "score").orderBy("doc_id").collect() for d, x in ((docs, labels), (moved, other)))
    assert one == two and len({r.score for r in one}) > 5


def test_stems():
    assert toxicity.stems("straßen".encode()) == ["stra*".encode(), "straß*".encode(), "straße*".encode()]
    places = toxicity.Places({b"stone": 1, b"ston*": 2})
    assert places[b"stone"] == (1, 2) and places[b"stony"] == (2,) and places[b"x"] == ()
    assert terms_of("It's ÜBER-12\x00x".encode()) == [b"it", b"s", "Über".encode(), b"12", b"x"]
