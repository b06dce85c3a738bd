"""The operators against plain Python on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mailscore.llm import (
    blocks, components, decontaminate, embeddings, language_id, licenses, minhash, packing, queries, scoring_lm, substring_dedup, surrogates, token_counts,
)
from mailscore.llm.blocks import crc_mod, importable

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, root string, n int"
WORDS = "the of and stone river mit license under version apache über straße ça naïve 12 x".split()


def table(spark, texts):
    """Documents with columns whose names clash with those that the operators use."""
    importable(spark)
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "r", 1) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    long = " ".join(draw.choice(WORDS) + draw.choice(["", ".", "\n"]) for _ in range(4000))
    some = [" ".join(draw.choice(WORDS) for _ in range(draw.randint(1, 120))) for _ in range(60)]
    out = [*some, long, "", None, " \n ", "a", some[3], some[3] + " end", some[4] + " " + some[5], "ΣΑΣ İ <|endoftext|> 'll", "!!! ... 42"]
    return [*enumerate(out), (0, out[0]), (None, some[7])]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return table(spark, texts).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_token_counts(docs, texts, empty):
    path = public.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = token_counts.count_tokens(docs, path, limit=50).collect()
    assert rows(token_counts.count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(
        [(i, len((t or "").encode()), size(t or ""), size(t or "") > 2048) for i, t in texts], key=repr
    )
    text = dict(texts)
    for r in got:
        whole = (text[r.doc_id] or "").encode()
        assert size(whole[: r.kept_bytes].decode()) <= 50
        if r.kept_bytes < len(whole):
            assert size((whole[: r.kept_bytes].decode() + whole[r.kept_bytes :].decode()[0])) >= 50
    assert token_counts.count_tokens(empty, path).count() == 0
    counter = token_counts.PrefixCounter(path)
    for chunk in ("unbelievable", "it's", "naïve!?", "Straße42", "<|endoftext|>x", "éa"):
        assert counter.every_prefix(chunk) == [size(chunk[:p]) for p in range(len(chunk) + 1)]


def test_lm(spark, docs, texts, empty):
    run = lambda d: scoring_lm.score(d, crc_mod("doc_id", 7) != 2, F.col("doc_id") % 5 == 0, size=3000)
    got = run(docs).collect()
    parts = [(i, (t or "").encode().lower().split() + [None]) for i, t in texts]
    train = [i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in parts]
    c = Counter(w for (_, p), t in zip(parts, train, strict=True) if t for w in p)
    n, v = sum(c.values()), len(c)
    want = sorted((repr(i), i is not None and not t, len(p), sum(c[w] > 0 for w in p), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in p), 6)) for (i, p), t in zip(parts, train, strict=True))
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 for r in got)
    assert run(empty).count() == 0
    weights = scoring_lm.learn([(1, 80, 8, 50), (1, scoring_lm.ZERO, 8, 50)])
    assert np.allclose(weights.sum(axis=1), 1) and weights[1][0] > 0.3


def interpolated(texts, train, fold, asked):
    """Scores of word lists by plain deleted interpolation of exact counts; the weights come from ratios in steps of 1 / STEP of a doubling."""

    def counts(some):
        one, two = Counter(), Counter()
        for words in some:
            one.update([*words, None])
            two.update(zip(["<s>", *words], [*words, None], strict=True))
        return one, two, len(some)

    def parts(c, v, w):
        one, two, starts = c
        context = starts if v == "<s>" else one[v]
        return context, (two[v, w] / context if context else 0.0), one[w] / sum(one.values()), 1 / (len(one) + 1)

    def step(ratio):
        return 2 ** (round(scoring_lm.STEP * math.log2(ratio)) / scoring_lm.STEP) if ratio else 0.0

    kept, whole = counts([texts[i] for i in train if i not in fold]), counts([texts[i] for i in train])
    cells = Counter()
    for i in fold:
        for v, w in zip(["<s>", *texts[i]], [*texts[i], None], strict=True):
            context, p2, p1, p0 = parts(kept, v, w)
            cells[context.bit_length(), step(p2 / p0), step(p1 / p0)] += 1

    def fit(some):
        weights = [1 / 3] * 3
        for _ in range(100):
            total = [0.0] * 3
            for (_, r2, r1), n in some.items():
                share = [weights[0] * r2, weights[1] * r1, weights[2]]
                for j in range(3):
                    total[j] += n * share[j] / sum(share)
            weights = [t / sum(total) for t in total]
        weights = [max(x, 1e-9) for x in weights]
        return [x / sum(weights) for x in weights]

    everything = fit(cells)
    of = {k: fit({c: n for c, n in cells.items() if c[0] == k}) for k in {c[0] for c in cells}}

    def probability(v, w):
        context, *p = parts(whole, v, w)
        return sum(x * y for x, y in zip(of.get(context.bit_length(), everything), p, strict=True))

    for v in ["<s>", *(w for w in whole[0] if w)]:  # a distribution: all known words, the end and one unknown word
        assert abs(sum(probability(v, w) for w in [*whole[0], "unknown"]) - 1) < 1e-9
    return [sum(math.log10(probability(v, w)) for v, w in zip(["<s>", *text], [*text, None], strict=True)) for text in asked]


def test_lm_scores_by_plain_interpolation(spark):
    """Scores equal those of plain counts in dictionaries."""
    importable(spark)
    draw = random.Random(3)
    words = "a b c d e f g h".split()
    texts = [draw.choices(words, weights=range(1, 9), k=draw.randint(0, 30)) for _ in range(120)]
    train, fold = [i for i in range(120) if i % 4], {i for i in range(120) if i % 4 and i % 5 == 0}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in scoring_lm.score(docs, F.col("doc_id") % 4 != 0, F.col("doc_id") % 5 == 0, size=500).collect()}
    want = interpolated(texts, train, fold, texts)
    assert all(abs(got[i] - want[i]) <= 1e-6 for i in range(120))


def test_lm_is_a_distribution(spark):
    """Probabilities of all continuations of a context, known words and one unknown, add up to 1."""
    importable(spark)
    train = [(i, "a b c a b") for i in range(8)] + [(10 + i, "b c") for i in range(5)]
    asked = [(100 + i, t) for i, t in enumerate(["a", "b", "c", "zz", ""])]
    all_ = spark.createDataFrame(train + asked, "doc_id long, text string")
    got = {r.doc_id: r.score for r in scoring_lm.score(all_, F.col("doc_id") < 100, F.col("doc_id") % 4 == 0).collect()}
    assert got[100] > got[103] and got[101] > got[103]


def test_licenses(docs, texts, empty):
    import re

    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for i, t in texts:
        w = word.findall((t or "").encode().lower())
        at = [(k, label) for phrase, label in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.encode().split()]
        want.append((i, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    got = licenses.scan(docs)
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    assert got.where("score < 0 OR score > 1 OR (base_labels <> '' AND score <> 1)").count() == 0
    assert licenses.scan(empty).count() == 0


def test_license_templates(spark):
    said = [(k, f"foo bar {text}. baz") for k, (_, text, _) in enumerate(licenses.TEMPLATES)]
    plain = [(100 + k, "some words about a river and stones") for k in range(80)]
    got = dict(rows(licenses.scan(table(spark, said + plain)), "doc_id", "labels"))
    assert all(licenses.TEMPLATES[k][0] in got[k].split(",") for k, _ in said)
    assert all(got[k] == "" for k, _ in plain)


def test_licenses_of_a_hot_source(spark):
    """A notice in a third of the rows is found in all of them."""
    for notice, label in (("Licensed under CC BY-SA 4.0.", "cc-by-sa"), ("All rights reserved.", "all-rights-reserved")):
        said = [(k, f"word{k} of a river {notice if k % 3 == 0 else 'and stones'}") for k in range(90)]
        got = dict(rows(licenses.scan(table(spark, said)), "doc_id", "labels"))
        assert [got[k] for k, _ in said] == [label if k % 3 == 0 else "" for k, _ in said]


def test_licenses_in_one_file(spark):
    """No template's lookup depends on which others stand in the text."""
    whole = ". ".join(text for _, text, _ in licenses.TEMPLATES)
    some = ". ".join(licenses.TEMPLATES[k][1] for k in (1, 9, 2, 4))
    plain = [(100 + k, "some words about a river and stones") for k in range(80)]
    got = dict(rows(licenses.scan(table(spark, [(1, whole), (2, some), *plain])), "doc_id", "labels"))
    assert got[1] == ",".join(sorted({label for label, _, _ in licenses.TEMPLATES}))
    assert {"mit", "bsd", "apache-2", "gpl-3"} <= set(got[2].split(","))


def test_license_labels_by_brute_force(spark):
    """Labels and scores equal those of every template tried at every place, with no index."""
    import re

    draw = random.Random(8)
    texts = []
    for _ in range(400):
        out = []
        for _ in range(draw.randint(0, 3)):
            words = draw.choice(licenses.TEMPLATES)[1].split()
            a = draw.choice([0, 0, draw.randint(0, len(words))])
            words = words[a:] if draw.random() < 0.3 else words
            out += [w if draw.random() > draw.choice([0, 0.1, 0.3]) else draw.choice(["river", "the", "license", "\u212a", "2"]) for w in words]
            out += draw.choices(WORDS, k=draw.randint(0, 20))
        texts.append(draw.choice([" ", ". ", "-"]).join(w.upper() if draw.random() < 0.2 else w for w in out))
    texts += ["software wor\u212a", None, "", texts[0], " license" * 3000]
    found = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    docs = table(spark, enumerate(texts))
    counts = {w: sum(w in f for f in found) for w in licenses.vocabulary()}
    assert licenses.document_frequencies(docs) == (len(texts), {w: n for w, n in counts.items() if n})
    templates, want = licenses.index(len(texts), counts), []
    for i, f in enumerate(found):
        normal = " " + " ".join(f) + " "
        labels, score = {label for phrase, label in licenses.BASE if f" {phrase} " in normal}, 0.0
        base = bool(labels)
        for (label, _, phrases), t in zip(licenses.TEMPLATES, templates, strict=True):
            best = max(sum(x for w, q, x in t.posted if 0 <= at + q < len(f) and f[at + q] == w) for at in range(-100, len(f) + 1))
            if best >= licenses.SHARE * t.weight and all(f" {p} " in normal for p in phrases):
                labels.add(label)
                score = max(score, best / t.weight)
        want.append((i, len(f), ",".join(sorted(labels)), 1.0 if base else score))
    assert sum(x[2] != "" for x in want) > 100
    assert rows(licenses.scan(docs), "doc_id", "n_words", "labels", "score") == sorted(want, key=repr)


def test_encoder_equals_library():
    """Ids put together from joints, words and tails are those of the library, also when the store is emptied in between."""
    path = public.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    tool = packing.Encoder(path, cached=300)
    draw = random.Random(11)
    atoms = ["river", "Él", "straße", "слово", "×", "÷3", "é", "'s", "'ll", "'", ".", ",", "...", "!?", "\n", "\r\n", "\t", " ", "  ", "\xa0", "\u2003", "7", "2024", "a", "A", "東京", "ー", "e\u0301", "—", "_", "{", "~", "\x7f", "\x00", "[x]", "don't", "ʼn", "😀"]
    for _ in range(40):
        texts = ["".join(draw.choices(atoms, k=draw.randint(0, 60))) + draw.choice(["", " ", "\n", "<|endoftext|>"]) for _ in range(50)]
        want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
        assert tool.encode([t.encode() for t in texts]) == want


PRIVATE = "Mail Anna.S7@Mail.example.org, anna.s7@mail.example.org; +1 (614) 555-8001 or +1 614-555-8001; 4111-1111-1111-1111, not 4111111111111112; 10.1.2.3; Mrs. Jane Doe, Господин Иван Петров"


def test_surrogates(spark, docs, texts, empty):
    both = table(spark, [(1, PRIVATE), (2, None), (3, "no data"), (4, PRIVATE), (5, 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"')])
    got = {r.doc_id: r for r in surrogates.pseudonymise(both, "k").collect()}
    assert set(both.columns) | {"n_entities"} == set(surrogates.pseudonymise(both, "k").columns)
    new = got[1].text
    assert got[4].text == new and got[2].text is None and got[3].text == "no data" and got[1].n_entities == 8
    assert not any(x in new for x in ("Anna.S7", "anna.s7", "555-8001", "4111-1111", "10.1.2.3", "Jane", "Иван"))
    assert "4111111111111112" in new and "Mrs. " in new and "Господин " in new
    mails = [w.strip(",;") for w in new.split() if "@" in w]
    assert len(set(mails)) == 1
    assert new.split(";")[1].count("555") == 0
    card = "".join(ch for ch in new.split(";")[2].split(",")[0] if ch.isdigit())
    assert sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(card))) % 10 == 0
    assert got[5].text.startswith('TOKEN = "') and got[5].text.upper() == got[5].text and "9233A8" not in got[5].text
    assert surrogates.pseudonymise(empty, "k").count() == 0
    assert surrogates.pseudonymise(both, "other").where("doc_id = 1").first().text != new


def test_cards_beside_other_figures(spark):
    """A card is replaced whatever stands next to it, and what stands next to it stays."""
    card, other = "4111 1111 1111 1111", "5500-0000-0000-0004"
    said = [f"{card} 12/27", f"{card} 123", f"123 {card}", f"{card} {other} 7", f"{card} 123-45-6789", f"{card} 10.1.2.3", "3782 822463 10005 99", "4111111111111111 123", "1 2 3 4 5 6 7 8 9", "4111 1111 1111 1112"]
    got = {r.doc_id: r for r in surrogates.pseudonymise(table(spark, list(enumerate(said))), "k").collect()}
    new = [got[k].text for k in range(len(said))]
    assert [got[k].n_entities for k in range(len(said))] == [1, 1, 1, 2, 2, 2, 1, 1, 0, 0]
    assert new[0].endswith(" 12/27") and new[1].endswith(" 123") and new[2].startswith("123 ") and new[3].endswith(" 7") and new[6].endswith(" 99")
    mine = new[0][:19]
    assert mine != card and new[1][:19] == new[2][4:] == new[3][:19] == new[4][:19] == new[5][:19] == mine and new[7] == mine.replace(" ", "") + " 123"
    assert not any(x in "".join(new) for x in ("4111 1111 1111 1111", "0000-0000", "123-45-6789", "10.1.2.3", "822463", "4111111111111111"))
    assert new[8:] == said[8:] and all(len(a) == len(b) for k, (a, b) in enumerate(zip(new, said)) if k != 5)


def test_lists_of_numbers_stay(spark):
    """Years, pages, results, books and phone-like tables are no cards; columns of the caller keep their values."""
    draw = random.Random(2)
    said = [" ".join(map(str, range(1, n))) for n in (10, 20, 30, 100)]
    said += [" ".join(map(str, range(1990, 2025))), "-".join(map(str, range(1000, 1024))), "1111 2222 3333 4444", "ISBN 9780306406157, 978-0-306-40615-7"]
    said += [" ".join(str(draw.randint(0, 99999)) for _ in range(40)) for _ in range(20)]
    said += [" ".join(str(draw.randint(4000, 4999)) for _ in range(n)) for n in (5, 6, 7, 9, 40)] + ["7 " * 300_000]
    frame = spark.createDataFrame([(i, t, "f", "n", "t", "l") for i, t in enumerate(said)], "doc_id long, text string, _found string, _new string, _text string, _later string")
    got = sorted(surrogates.pseudonymise(frame, "k").collect())
    assert [r.text for r in got] == said and {r.n_entities for r in got} == {0}
    assert {tuple(r)[2:6] for r in got} == {("f", "n", "t", "l")}
    mixed = surrogates.pseudonymise(table(spark, [(0, "call 614-555-8001 or 614-555-8001, not 1-614-555-8001-2")]), "k").first().text.replace(",", "").split()
    assert mixed[1] == mixed[3] != "614-555-8001" and mixed[1].count("-") == 2 and mixed[5] == "1-614-555-8001-2"


def test_surrogate_collisions(spark, monkeypatch):
    """With a tiny space of surrogates distinct entities still get distinct ones, none of them real."""
    made = surrogates.surrogate

    def narrow(type_, entity, attempt, key):
        number = F.pmod(F.conv(F.substring(made(type_, entity, attempt, key), 1, 3), 10, 10).cast("long") + attempt * 7, F.lit(40))
        return F.when(type_ == "ssn", F.lpad((number + 100).cast("string"), 9, "9")).otherwise(made(type_, entity, attempt, key))

    monkeypatch.setattr(surrogates, "surrogate", narrow)
    people = table(spark, [(i, f"number 123-45-67{i:02d} again 123-45-67{i:02d}") for i in range(20)])
    got = [r.text.split() for r in surrogates.pseudonymise(people, "k").collect()]
    assert all(t[1] == t[3] for t in got) and len({t[1] for t in got}) == 20


def test_language(spark, sf, docs, empty):
    got = queries.op5_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").collect()
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    model = language_id.fit(docs)
    out = language_id.predict(docs, model, lang="lang", prob="score")
    assert set(out.columns) == set(docs.columns) and out.count() == docs.count()
    assert {r.lang for r in out.where("text IS NULL OR trim(text) IN ('', '!!! ... 42') OR doc_id = 63").collect()} == {"und"}
    assert language_id.fit(empty).langs == [] and language_id.predict(empty, model).count() == 0
    assert language_id.predict(docs, language_id.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_packing_encodes_a_bounded_number_of_bytes_at_once(monkeypatch):
    batch = pa.record_batch({"doc_id": pa.array(range(200)), "text": pa.array([f"{i} " + "word " * 8000 for i in range(200)])})
    assert batch.nbytes > 7 << 20  # as Spark may send it
    parts = list(blocks.gathered(iter([batch, batch]), size=1 << 20))
    assert max(p.nbytes for p in parts) < 2 << 20 and pa.concat_batches(parts).equals(pa.concat_batches([batch, batch]))
    seen, tool = [], packing.encoder(public.path("byte_bpe_50k.json"))

    class Watched:
        def flat(self, texts):
            seen.append(sum(map(len, texts)))
            return tool.flat(texts)

    class Table:
        def selectExpr(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    monkeypatch.setattr(packing, "encoder", lambda _: Watched())
    out = pa.Table.from_batches(packing.pieces(Table(), "")(iter([batch])))
    assert out["doc_id"].unique().to_pylist() == list(range(200)) and sum(seen) > 7 << 20
    assert max(seen) < 4 << 20


def test_packing(docs, texts, empty):
    path = public.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    cap = 64
    got = packing.pack(packing.pieces(docs, path, cap, ids=True), cap).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.length == len(r.ids) <= cap
    text = dict(texts)
    for doc, pieces in parts.items():
        want = library.encode(text[doc] or "", add_special_tokens=False).ids + [2]
        copies = sum(i == doc for i, _ in texts)
        ordered = sorted(pieces, key=lambda r: r.piece)[::copies]
        assert [x for r in ordered for x in r.ids] == want and all(r.length == cap for r in ordered[1:])
    bins = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    total = sum(r.length for r in got)
    assert max(bins.values()) <= cap and len(bins) <= -(-total // cap) + 3
    assert packing.pack(packing.pieces(empty, path)).count() == 0


def test_plan_is_full():
    draw = random.Random(2)
    for _ in range(30):
        counts = Counter(draw.randint(1, 30) for _ in range(draw.randint(1, 200)))
        used = Counter()
        for length, first, copies, _, _ in packing.plan(dict(counts), 30):
            assert first >= used[length]
            used[length] = first
        assert packing.fullest({7: 3, 5: 1}, 20) in ({7: 2, 5: 1},)


def test_odd_texts_are_encoded_alike():
    tool = packing.Encoder(public.path("byte_bpe_50k.json"))
    draw = random.Random(3)
    odd = ["".join(draw.choice("ab' \n\t é1.!\xa0") for _ in range(40)) for _ in range(300)] + ["x <|endoftext|> y", "a  <|endoftext|>", ""]
    assert tool.encode([t.encode() for t in odd]) == [np.array(tool.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]


def test_embeddings(spark):
    importable(spark)
    draw = np.random.default_rng(4)
    base = draw.normal(size=(40, 64))
    vectors = [*base, *(base[:15] + draw.normal(size=(15, 64)) * 0.08), *(base[0] + draw.normal(size=(30, 64)) * 0.1), base[3], base[3] * 2]
    rows_ = [(i, [float(x) for x in v], int(i % 1)) for i, v in enumerate(vectors)]
    n = len(rows_)
    rows_ += [(n, None, 0), (n + 1, [0.0] * 64, 0), (n + 2, [float("nan")] * 64, 0), (n + 3, [1.0, None], 0), (n + 4, rows_[3][1], None), (n + 5, rows_[3][1], 1), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df, block=8).collect()}
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    assert sum(got[i][0] for i in range(n)) >= 0.95 * near.sum() and all(got[i][0] <= near[i].sum() for i in range(n))
    assert got[3][0] == near[3].sum() and got[n - 1][1] == got[3][1] == 3
    assert all(got[n + k] == (0, n + k, True) for k in range(6)) and got[n + 7] == (1, n + 6, False)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [50_000, 40])
def test_substring(spark, docs, texts, empty, monkeypatch, bucket):
    monkeypatch.setattr(substring_dedup, "BUCKET", bucket)
    more = [(200 + k, "p " * k + " ".join(f"w{j}" for j in range(70)) + f" q{k}") for k in range(12)] + [(300, "z " * 300), (301, "z " * 120)]
    all_ = [*texts, *more]
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in all_]
    for i, w in words:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    want = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    got = substring_dedup.remove_repeats(table(spark, all_))
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_decontamination(spark, docs, empty):
    draw = random.Random(8)
    item = [f"k{draw.randint(0, 500)}" for _ in range(30)]
    changed = [w if k % 9 else "other" for k, w in enumerate(item)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "six words that are quite short"), (3, None), (4, "too few"), (None, "x " * 20)], "item_id long, text string")
    said = [(1, "so " + " ".join(item).upper() + "!"), (2, " ".join(changed)), (3, " ".join(item[:8])), (4, "Six words, that are quite short."), (5, None), (6, ""), (7, "too few"), (8, " ".join(item[::-1]))]
    all_ = table(spark, said)
    assert rows(decontaminate.contaminated(all_, bench), "doc_id", "item_id") == [(1, 1), (2, 1), (4, 2)]
    assert decontaminate.contaminated(all_, bench).where("doc_id = 1").first().n_equal == 30
    left = decontaminate.decontaminate(all_, bench)
    assert left.schema == all_.schema and rows(left, "doc_id") == [(3,), (5,), (6,), (7,), (8,)]
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(all_, bench.limit(0)).count() == 0


def test_decontamination_of_substituted_items(spark):
    """An item with a quarter of its words substituted is a leak at any length; with half of them it is none."""
    draw = random.Random(9)
    items, said, wanted = [], [], []
    for n in (5, 8, 12, 13, 15, 16, 18, 23, 30):
        for _ in range(12):
            item, i = [f"w{draw.randint(0, 10**6)}" for _ in range(n)], len(items)
            items.append((i, " ".join(item)))
            for k, part in ((2 * i, n // 4), (2 * i + 1, (n + 1) // 2)):
                gone = set(draw.sample(range(n), part)) if k % 2 == 0 else set(range(0, n, 2))
                said.append((k, "some words before " + " ".join("x" if j in gone else w for j, w in enumerate(item)) + " and after"))
            wanted.append((2 * i, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows(decontaminate.contaminated(table(spark, said), bench), "doc_id", "item_id") == sorted(wanted, key=repr)


def test_minhash(spark, docs, texts, empty):
    draw = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    copies = []
    for k in range(60):
        words = list(base)
        for _ in range(draw.randint(0, 8)):
            words[draw.randrange(len(words))] = f"c{draw.randint(0, 9)}"
        copies.append((400 + k, " ".join(words)))
    all_ = [*texts, *copies, (500, "one two"), (501, "ONE two"), (502, "two one")]
    sets = {}
    for i, t in all_:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(table(spark, all_)).collect()
    assert len(got) == len(all_)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (top(r.doc_id), r.doc_id == top(r.doc_id))
            assert r.n_shingles in [len(s) for s in sets[r.doc_id]]
    assert minhash.near_duplicates(empty).count() == 0


def test_components(spark):
    draw = random.Random(1)
    pairs = [(draw.randint(0, 60), draw.randint(0, 60)) for _ in range(35)] + [(100 + k, 101 + k) for k in range(40)] + [(5, 5)]
    parent = {i: i for p in pairs for i in p}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    linked = {i for a, b in pairs if a != b for i in (a, b)}
    got = rows(components.components(spark.createDataFrame(pairs, "a long, b long")), "node", "root")
    assert got == sorted(((i, top(i)) for i in linked), key=repr)


def test_pipeline_stages(spark, sf, docs):
    importable(spark)
    have = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "benchmark_decontamination", "pii_surrogates", "best_fit_packing"]
    same = have.select([F.col(c) for c in have.columns]).unionByName(docs.select(have.columns))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        same = stage(spark, same, sf).checkpoint()
        assert same.columns == have.columns
        assert stage(spark, have.limit(0), sf).count() == 0
    ids = [r.doc_id for r in same.select("doc_id").collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and same.where("n_chars <> length(text)").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, same, sf)
    assert last.select("doc_id").distinct().count() >= len(ids)


def test_pipeline_without_languages_and_with_repeated_ids(spark, sf):
    rows = [(1, "some words", None, "s", 10), (2, "12 34", None, "s", 5), (3, "other text of three", None, "s", 3), (3, "a text of three", None, "s", 3), (None, "no id", None, "s", 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _lang string")
    left = corpus_pipeline.languages(spark, docs, sf)
    assert sorted((r.text for r in left.collect())) == ["a text of three", "no id", "other text of three", "some words"]
    assert left.columns == docs.columns
    for _ in range(2):
        once = corpus_pipeline.near_duplicates(spark, left.repartition(3), sf).collect()
        smallest = min(("other text of three", "a text of three"), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
        assert sorted(r.text for r in once) == sorted(["some words", "no id", smallest])
    known = docs.withColumn("lang", F.lit("en"))
    assert {r._lang for r in corpus_pipeline.languages(spark, known, sf).collect()} <= {"x"}
