"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of every n-gram cell and language are summed by Spark over all labelled rows; the matrix of log probabilities, of
a size fixed by the number of cells and languages, goes to every task, where numpy scores batches of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscore.llm.blocks import crc_mod, slices

CELLS = 1 << 15
ORDERS = (2, 3)
AT_ONCE = 1 << 20  # n-grams scored at once
BLANK = 32
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    langs: list[str]
    log_prior: np.ndarray  # one value for a language
    log_prob: np.ndarray  # languages x cells


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter; one table for each Python process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str | None]):
    """Chunks of (row, cell) of the n-grams of lower-case letters, runs of anything else being one blank.

    Rows without a letter have none. Long texts come in several chunks.
    """
    for first in range(0, len(texts), 64):
        part = [f" {t.lower()} " if t else "" for t in texts[first : first + 64]]
        codes = np.frombuffer("".join(part).encode("utf-32-le", "replace"), np.uint32)
        if not len(codes):
            continue
        rows = np.repeat(np.arange(first, first + len(part)), [len(t) for t in part])
        codes = np.where(_letters()[codes], codes, np.uint32(BLANK))
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != BLANK) | (codes[:-1] != BLANK) | (rows[1:] != rows[:-1])
        codes, rows = codes[keep], rows[keep]
        for n in ORDERS:
            for start in range(0, max(0, len(codes) - n + 1), AT_ONCE):
                end = min(start + AT_ONCE, len(codes) - n + 1)
                key = np.full(end - start, n, np.uint32)
                for i in range(n):
                    key = key * np.uint32(0x01000193) ^ codes[start + i : end + i]
                key = (key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                whole = rows[start:end] == rows[start + n - 1 : end + n - 1]
                yield rows[start:end][whole], (key >> np.uint32(17))[whole].astype(np.int64)


def has_letter(texts: list[str | None]) -> list[bool]:
    return [any(map(str.isalpha, t)) if t else False for t in texts]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> Model:
    """Learns from every row with a text and a language. Without any such row the model knows no language."""

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        number: dict[str, int] = {}
        for batch in slices(batches):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names = list(dict.fromkeys(langs))
            code = np.array([names.index(x) for x in langs], np.int64)
            for name in names:
                seen.setdefault(name, np.zeros(CELLS, np.int64))
                number[name] = number.get(name, 0) + langs.count(name)
            for rows, cells in grams(texts):
                both = np.bincount(code[rows] * CELLS + cells, minlength=len(names) * CELLS)
                for i, name in enumerate(names):
                    seen[name] += both[i * CELLS : (i + 1) * CELLS]
        for name, counts in seen.items():
            cells = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict(
                {"lang": [name] * (len(cells) + 1), "cell": [-1, *cells.tolist()], "n": [number[name], *counts[cells].tolist()]}
            )

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    summed = rows.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    table = summed.toPandas()  # at most languages x (cells + 1) rows
    if table.empty:
        return Model([], np.zeros(0), np.zeros((0, CELLS)))
    langs = sorted(table["lang"].unique())
    counts, docs_of = np.zeros((len(langs), CELLS)), np.zeros(len(langs))
    at = table["lang"].map({name: i for i, name in enumerate(langs)}).to_numpy()
    cell, n = table["cell"].to_numpy(), table["n"].to_numpy()
    docs_of[at[cell < 0]] = n[cell < 0]
    counts[at[cell >= 0], cell[cell >= 0]] = n[cell >= 0]
    prob = (counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * CELLS)
    return Model(langs, np.log(docs_of / docs_of.sum()), np.log(prob))


def score(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and its posterior probability; ``und`` and 0 for a text that is null or has no letter."""
    if not model.langs:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    total = np.tile(model.log_prior, (len(texts), 1))
    for rows, cells in grams(texts):
        if len(rows):
            low = rows[0]
            for k in range(len(model.langs)):
                sums = np.bincount(rows - low, weights=model.log_prob[k][cells])
                total[low : low + len(sums), k] += sums
    best = total.argmax(axis=1)
    top = total[np.arange(len(texts)), best] if len(texts) else np.zeros(0)
    sure = 1 / np.exp(total - top[:, None]).sum(axis=1)
    known = has_letter(texts)
    langs = [model.langs[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
    return langs, [float(s) if k else 0.0 for s, k in zip(sure, known, strict=True)]


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang: str = "lang_pred", prob: str = "score") -> DataFrame:
    """Every row with two further columns (in place of columns of these names), the language and its probability.

    Nothing but the text is looked at. Empty tables, repeated rows and nulls in other columns pass through.
    """
    rest = [c for c in docs.columns if c not in (lang, prob)]
    out = docs.select(*[F.col(f"`{c}`") for c in rest])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x CELLS numbers

    def run(batches):
        for batch in slices(batches):
            langs, probs = score(shared.value, batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(probs, pa.float64())], names=[*rest, lang, prob]
            )

    schema = out.withColumn(lang, F.lit("").cast("string")).withColumn(prob, F.lit(0.0)).schema
    for field in schema.fields[-2:]:
        field.nullable = True
    return out.mapInArrow(run, schema)


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows to learn from: CRC-32 of the id as text, modulo 4, is not 2. Rows without an id are left out."""
    return docs.where(crc_mod(id_col, 4) != 2)
