"""Terms of a corpus: frequencies, TF-IDF, and the terms that mark a class.

The corpus is read twice, from its words, written out once. The first pass
counts words exactly and pairs of words by hash bucket: a sketch of fixed size
that partial results are added up in. A pair is at most as frequent as its
bucket and as either word, and a term belongs to a vocabulary of ``size`` only
if it is as frequent as the word in that place. So the second pass counts,
exactly, what can still reach the vocabulary; the rest is dropped inside its
row by a look at two bit maps. The tokens are never shuffled by document, and
weights and scores are worked out in the row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from mailscore import constants as c
from mailscore.functions import text as tx
from mailscore.operators.once import compute_once, explode_once
from mailscore.session import ensure_checkpoint_dir

_NO_TERMS = "cast(array() as array<string>)"

# Hash buckets in which pairs of words are counted; a power of two. Every bit map of them has an eighth as many bytes.
BUCKETS = 1 << 18


def _words(df: DataFrame, text: str, stop_words: list[str] | None) -> Column:
    """Words of a text without stop words; a column that holds words already (:func:`tokenized`) stays as it is."""
    if isinstance(df.schema[text].dataType, ArrayType):
        return F.coalesce(F.col(text), F.expr(_NO_TERMS))
    stops = c.STOP_WORDS if stop_words is None else stop_words
    words = F.coalesce(tx.tokens(F.col(text)), F.expr(_NO_TERMS))
    return F.filter(words, lambda w: ~w.isin(stops)) if stops else words


def tokenized(df: DataFrame, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """The rows with the words of the text in place of it, written out once for all functions of this module."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.withColumn(text, _words(df, text, stop_words)).checkpoint()


def add_terms(df: DataFrame, text: str, out: str = "terms", stop_words: list[str] | None = None) -> DataFrame:
    """Adds the words of a text without stop words, followed by the pairs of neighbours."""
    df = df.withColumn("_words", _words(df, text, stop_words))
    return df.withColumn(out, F.concat("_words", _pairs("_words"))).drop("_words")


def _pairs(words: str) -> Column:
    """Neighbours, joined by a blank; null where one of them is null."""
    most = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, most), F.slice(words, 2, most), lambda a, b: F.concat(a, F.lit(" "), b))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS))


def _bit_map(buckets: DataFrame) -> Callable[[Column], Column]:
    """A test inside the row whether a term's bucket is among these; the driver holds ``BUCKETS`` bits of it."""
    cells = buckets.groupBy(F.shiftright("bucket", 6).alias("cell"))
    bits = [0] * (BUCKETS // 64)
    for row in cells.agg(F.bit_or(F.expr("shiftleft(1L, cast(bucket & 63 as int))")).alias("bits")).collect():
        bits[row.cell] = row.bits
    known = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")  # folded to a constant
    return lambda t: F.getbit(F.get(known, F.shiftright(_bucket(t), 6).cast("int")), (_bucket(t) % 64).cast("int")) == 1


def _last_place(counts: DataFrame, size: int) -> int | None:
    """Frequency of the word in the last place of a vocabulary; None if there are fewer words than places."""
    # every frequency has a word or more, so the first ``size`` frequencies reach the last place
    steps = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.col("n").desc()).limit(size).collect()
    reached = 0
    for step in steps:
        reached += step.words
        if reached >= size:
            return step.n
    return None


def frequent_terms(words: DataFrame, column: str, size: int) -> DataFrame:
    """terms: per row those that can be among the ``size`` most frequent terms of the table, and few others."""
    buckets = F.transform(_pairs(column), lambda p: F.concat(F.lit(" "), _bucket(p).cast("string")))  # no word has a blank
    keys = explode_once(words, [], F.concat(column, buckets), "key")
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).checkpoint()
    pair = F.startswith("key", F.lit(" "))
    least = _last_place(counts.where(~pair), size)
    if least is None:
        return words.select(F.concat(column, _pairs(column)).alias("terms"))
    enough = counts.where(F.col("n") >= least)
    word_known = _bit_map(enough.where(~pair).select(_bucket(F.col("key")).alias("bucket")))
    pair_known = _bit_map(enough.where(pair).select(F.substring("key", 2, 20).cast("long").alias("bucket")))
    rows = words.select(F.transform(column, lambda w: F.when(word_known(w), w)).alias("_known"))
    pairs = F.transform(_pairs("_known"), lambda p: F.when(pair_known(p), p))
    return rows.select(F.array_compact(F.concat("_known", pairs)).alias("terms"))


def term_frequencies(
    df: DataFrame, text: str, candidates_for: int | None = None, stop_words: list[str] | None = None
) -> DataFrame:
    """term, cf (occurrences), df (documents).

    With ``candidates_for`` most terms that cannot be among that many most
    frequent ones are left out before they are counted; all counts are exact.
    """
    if candidates_for:
        if not isinstance(df.schema[text].dataType, ArrayType):
            df = tokenized(df.select(text), text, stop_words)
        terms = frequent_terms(df, text, candidates_for)
    else:
        terms = add_terms(df.select(text), text, stop_words=stop_words)
    terms = terms.select(F.sort_array("terms").alias("terms"))  # equal terms side by side: the first of them counts the document
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), "terms"), 1, F.size("terms"))
    each = F.zip_with("terms", before, lambda t, b: F.struct(t.alias("term"), (~t.eqNullSafe(b)).cast("int").alias("first")))
    rows = explode_once(terms, [], each, "t").select("t.*")
    return rows.groupBy("term").agg(F.count("*").alias("cf"), F.sum("first").alias("df"))


def vocabulary(
    df: DataFrame, text: str, size: int = c.VOCABULARY_SIZE, stop_words: list[str] | None = None
) -> DataFrame:
    """term, cf, df of the most frequent terms; of equals the first in the alphabet."""
    counted = term_frequencies(df, text, size, stop_words)
    return counted.orderBy(F.col("cf").desc(), F.col("term")).limit(size)


@dataclass(frozen=True)
class Weights:
    """A vocabulary with its smooth inverse document frequencies: ln((1 + N) / (1 + df)) + 1."""

    terms: list[str]
    idf: list[float]
    stop_words: list[str] | None = None

    @classmethod
    def fit(
        cls, df: DataFrame, text: str, size: int = c.VOCABULARY_SIZE, stop_words: list[str] | None = None
    ) -> Weights:
        n = df.agg(F.count("*").alias("n")).scalar()
        idf = F.log((n + F.lit(1)) / (F.col("df") + 1)) + 1
        rows = vocabulary(df, text, size, stop_words).select("term", idf.alias("idf")).collect()  # bounded by size
        return cls([r.term for r in rows], [r.idf for r in rows], stop_words)

    def stages(self, terms: str = "terms", out: str = "tfidf") -> list:
        """Transformers from terms to the L2-normalised TF-IDF vector."""
        return [
            CountVectorizerModel.from_vocabulary(self.terms, inputCol=terms, outputCol="_tf"),
            ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_w"),
            Normalizer(p=2.0, inputCol="_w", outputCol=out),
        ]

    def tfidf(self, df: DataFrame, text: str, out: str = "tfidf") -> DataFrame:
        """Adds the TF-IDF vector of each row."""
        df = add_terms(df, text, "_terms", self.stop_words)
        for stage in self.stages("_terms", out):
            df = stage.transform(df)
        return df.drop("_terms", "_tf", "_w")


def class_differences(df: DataFrame, weights: Weights, text: str, label: str = "label") -> DataFrame:
    """term, phishing, legitimate, diff: mean weight of each term per class (absent terms count as 0)."""
    means = (
        weights.tfidf(df.where(F.col(label).isin(0, 1)), text)
        .groupBy(label)
        .agg(Summarizer.mean(F.col("tfidf")).alias("mean"))
        .select(label, F.posexplode(vector_to_array("mean")).alias("i", "w"))
    )
    per_term = means.groupBy("i").agg(
        F.coalesce(F.sum(F.when(F.col(label) == 1, F.col("w"))), F.lit(0.0)).alias("phishing"),
        F.coalesce(F.sum(F.when(F.col(label) == 0, F.col("w"))), F.lit(0.0)).alias("legitimate"),
    )
    vocab = df.sparkSession.createDataFrame(list(enumerate(weights.terms)), "i int, term string")
    return per_term.join(vocab, "i").select(
        "term", "phishing", "legitimate", (F.col("phishing") - F.col("legitimate")).alias("diff")
    )


def indicator_terms(differences: DataFrame, k: int = c.TERMS_PER_CLASS) -> DataFrame:
    """class, position, term, score: the ``k`` terms that mark each class most."""
    shown = F.round("diff", 6)

    def side(name: str, sign: int) -> DataFrame:
        top = differences.orderBy((shown * sign).desc(), F.col("term")).limit(k)
        return top.select(F.lit(name).alias("class"), "term", (F.col("diff") * sign).alias("score"))

    return side("phishing", 1).unionByName(side("legitimate", -1))


def score_by_terms(
    texts: DataFrame, text: str, differences: DataFrame, keys: list[str], weights: Weights
) -> DataFrame:
    """matched, avg_score, verdict per row from its distinct known terms; rows without any are left out.

    ``differences`` has a row per term of the vocabulary, whose size is a
    parameter. Terms are looked up in a hash table inside the row, and the score
    is a product of the sparse vector of the terms found: no shuffle.
    """
    diff = {r.term: r.diff for r in differences.select("term", "diff").collect()}  # bounded by the vocabulary
    if not diff:
        return texts.select(*keys, F.lit(0).cast("long").alias("matched"), F.lit(0.0).alias("avg_score"), F.lit("").alias("verdict")).limit(0)
    found = CountVectorizerModel.from_vocabulary(list(diff), inputCol="_terms", outputCol="_found", binary=True)
    score = ElementwiseProduct(scalingVec=Vectors.dense(list(diff.values())), inputCol="_found", outputCol="_scores")
    rows = add_terms(texts.select(*keys, F.col(text).alias("_text")), "_text", "_terms", weights.stop_words)
    values = F.unwrap_udt("_scores")["values"]
    rows = compute_once(score.transform(found.transform(rows)).select(*keys, values.alias("_values")), keys)
    rows = rows.where(F.size("_values") > 0)
    total = F.aggregate("_values", F.lit(0.0), lambda a, x: a + x)
    averaged = rows.select(*keys, F.size("_values").cast("long").alias("matched"), (total / F.size("_values")).alias("avg_score"))
    verdict = F.when(F.col("avg_score") > c.TERM_VERDICT_CUT, F.lit("SUSPICIOUS")).otherwise(F.lit("LIKELY SAFE"))
    return averaged.withColumn("verdict", verdict)
