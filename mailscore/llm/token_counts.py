"""Exact token counts by dynamic programming over prefixes of words.

A word-level BPE with a word-end mark encodes every white-space separated chunk by itself, and within a chunk every
piece that its pattern cuts out. For a piece the last token of the encoding of *every* prefix is fixed by the prefixes
before it: a token t can end the encoding of s[:i] exactly if the encoding of s[:i - len(t)] ends with a token that would
not merge with t. Walking i from left to right therefore gives the exact token count at every prefix, and the count of a
text cut anywhere is read off the stored prefixes, without encoding the cut text.
"""

from __future__ import annotations

import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from mailscore.llm.blocks import byte_texts, slices

# fixed values: white space and the cutting pattern of the tokenizer, as its file states them
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
CHUNK = regex.compile(rb"[^\x20\x09-\x0D]+")
END = "</w>"
CACHED = 600_000  # chunks whose counts a task remembers
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, kept_bytes long"


def byte_letters() -> dict[str, int]:
    """The letters that stand for the 256 bytes in byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter(dict):
    """Token counts of chunks (a dictionary that fills itself), and of every prefix of a chunk."""

    def __init__(self, path: str, cached: int = CACHED):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.cached = cached
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.inner = {raw(t): i for t, i in vocab.items() if not t.endswith(END)}
        self.final = {raw(t[: -len(END)]): i for t, i in vocab.items() if t.endswith(END)}
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.rank: dict[tuple[int, int], int] = {}
        size = max(vocab.values()) + 1
        self.born, self.halves = [-1] * size, [None] * size  # rank of the merge that makes a token, and its two sides
        for r, (a, b) in enumerate(merges):
            pair = vocab[a], vocab[b]
            self.rank.setdefault(pair, r)
            made = vocab[a + b]
            if self.halves[made] is None and self.born[made] < 0:
                self.born[made], self.halves[made] = r, pair
        self.whole = [False] * size  # tokens that their own text is encoded to
        for token in sorted(range(size), key=self.born.__getitem__):
            sides = self.halves[token]
            self.whole[token] = sides is None or (
                self.whole[sides[0]] and self.whole[sides[1]] and self._apart(*sides, self.born[token])
            )
        self.inner = {t: i for t, i in self.inner.items() if self.whole[i]}
        self.final = {t: i for t, i in self.final.items() if self.whole[i]}
        self.known: dict[int, bool] = {}  # whether two tokens stay apart
        self.pieces: dict[str, int] = {}

    def _apart(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether no merge older than ``before`` crosses the border of neighbours a and b.

        Time runs backwards: the younger of the two tokens at the border is replaced by its side at the border. Merges
        of one rank go from left to right, so a merge across the border precedes an equal one inside b, not inside a.
        """
        a_until = b_until = before
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < a_until and r <= b_until and r < before:
                return False
            if self.born[a] < 0 and self.born[b] < 0:
                return True
            if self.born[a] > self.born[b]:
                a_until, a = self.born[a], self.halves[a][1]
            else:
                b_until, b = self.born[b], self.halves[b][0]

    def _fits(self, a: int, b: int) -> bool:
        key = a << 20 | b
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= self.cached:
                self.known.clear()
            found = self.known[key] = self._apart(a, b)
        return found

    def _end(self, table: dict[bytes, int], piece: bytes, i: int, last: list[int]) -> tuple[int, int]:
        """The one token of ``table`` that ends the encoding of piece[:i], and where it starts."""
        for j in range(i - self.longest if i > self.longest else 0, i):
            token = table.get(piece[j:i])
            if token is not None and (j == 0 or self._fits(last[j], token)):
                return token, j
        raise ValueError(f"no encoding of {piece[:i]!r}")

    def prefixes(self, piece: bytes, upto: int) -> tuple[list[int], list[int]]:
        """Last token and token count of piece[:i], as the beginning of a longer piece, for every i up to ``upto``."""
        last, count, table, known, longest = [-1], [0], self.inner, self.known, self.longest
        for i in range(1, upto + 1):
            for j in range(i - longest if i > longest else 0, i):  # as in _end, without its calls: this is the hot loop
                token = table.get(piece[j:i])
                if token is not None:
                    if j == 0:
                        break
                    fits = known.get(last[j] << 20 | token)
                    if self._fits(last[j], token) if fits is None else fits:
                        break
            else:
                raise ValueError(f"no encoding of {piece[:i]!r}")
            last.append(token)
            count.append(count[j] + 1)
        return last, count

    def piece(self, piece: str) -> int:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= self.cached:
                self.pieces.clear()
            whole = piece.encode()
            last, count = self.prefixes(whole, len(whole) - 1)
            found = self.pieces[piece] = count[self._end(self.final, whole, len(whole), last)[1]] + 1
        return found

    @staticmethod
    def normal(text: str) -> str:
        """The tokenizer's normal form; letters change case one by one, without regard to their neighbours."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def text(self, text: str) -> int:
        """Tokens of any text."""
        for special in self.special:
            if special in text:
                head, tail = text.split(special, 1)
                return self.text(head) + 1 + self.text(tail)
        return sum(map(self.piece, PIECE.findall(self.normal(text))))

    def __missing__(self, chunk: bytes) -> int:
        if len(self) >= self.cached:
            self.clear()
        count = self[chunk] = self.text(chunk.decode("utf-8", "replace"))
        return count

    def every_prefix(self, chunk: str) -> list[int]:
        """Tokens of chunk[:p] for every p from 0 on."""
        normal = self.normal(chunk)
        odd = any(s in chunk for s in self.special) or not unicodedata.is_normalized("NFC", chunk)
        if odd or len(normal) != len(chunk):
            return [self.text(chunk[:p]) for p in range(len(chunk) + 1)]
        counts, done = [0], 0
        for match in PIECE.finditer(normal):
            counts += [done] * (match.start() + 1 - len(counts))
            piece, places = match[0], match.end() - match.start()
            if piece[0] == "'" and places > 1 and piece[1:].isalpha():  # a cut contraction is a mark and letters
                counts += [done + self.text(piece[: p + 1]) for p in range(places)]
            else:
                whole = piece.encode()
                last, count = self.prefixes(whole, len(whole) - 1)
                at = 0
                for letter in piece:
                    at += len(letter.encode())
                    counts.append(done + count[self._end(self.final, whole, at, last)[1]] + 1)
            done = counts[-1]
        return counts + [done] * (len(chunk) + 1 - len(counts))

    def cut(self, text: bytes, limit: int) -> int:
        """Bytes of the longest prefix of whole characters that holds at most ``limit`` tokens."""
        done = 0
        for match in CHUNK.finditer(text):
            more = self[match[0]]
            if done + more > limit:
                chunk = match[0].decode("utf-8", "replace")
                keep = max(p for p, n in enumerate(self.every_prefix(chunk)) if done + n <= limit)
                return match.start() + len(chunk[:keep].encode())
            done += more
        return len(text)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a vocabulary file, one for each Python process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, kept_bytes (longest prefix within the limit) of every row.

    Special strings inside a text are one token each. Null and empty texts have 0 tokens; a null id stays null; repeated
    rows give repeated results; other columns are ignored. Rows are worked on where they lie, nothing is shuffled, and a
    task holds a bounded store of counted chunks.
    """

    def run(batches):
        known = counter(path)
        for batch in slices(batches):
            texts = byte_texts(batch)
            tokens = [sum(map(known.__getitem__, t.split())) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(map(len, texts), pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                    pa.array([known.cut(t, limit) if n > limit else len(t) for t, n in zip(texts, tokens, strict=True)], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "kept_bytes"],
            )

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, SCHEMA)
