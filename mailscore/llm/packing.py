"""Packing of token sequences by minimum bin slack.

Documents are encoded once, where they lie, and cut into pieces. How pieces fill the bins depends on their lengths alone,
so the plan is made from the histogram of lengths (at most one entry for each length up to the bin size, however many
pieces there are): the longest open piece gets a bin, a subset-sum program over bits finds the fullest completion among
the lengths still open, and this bin is removed as often as the counts allow. Every such step uses up at least one
length, so a plan has no more kinds of bins than there are lengths. Pieces are then numbered within their length and
look their place up in the plan.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailscore.llm.blocks import byte_texts, gathered
from mailscore.session import ensure_checkpoint_dir

CAP = 1024
END_ID = 2
CACHED = 700_000  # words kept in a worker, and half as many parts
AT_ONCE = 2 << 20  # bytes of texts that are encoded together; the work on them takes some 20 times as much memory
# a space starts a new piece of the byte-level pattern wherever no white space follows it
JOINT = re.compile(rb" (?![\x09-\x0D\x20]|\xc2\x85|\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\Z)")
UNJOINED = r" ([\x09-\x0D\x20]|\xc2\x85|\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\z)"  # a space that is no joint
# letters (of ASCII, and some blocks that hold nothing else) before an ASCII character that is no letter, which starts a new piece
WORD = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xd0\xd1][\x80-\xbf])+(?=[\x00-\x40\x5b-\x60\x7b-\x7f])")


class Encoder(dict):
    """Ids, as little-endian 32-bit bytes, of what stands between two joints and is no plain word; filled from the library in batches.

    Parts are put together from words and what follows these (``.``, ``.\\nThen``), so that a word is encoded once in
    whatever surroundings it stands.
    """

    def __init__(self, path: str, cached: int = CACHED):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.cached = cached
        self.words: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {}
        self.lead = len(self.ids([" a"])[0])
        vocab = self.library.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of a token: its name has a letter for each
        for token, i in vocab.items():
            self.width[i] = len(token)

    def coded(self, parts: list[bytes]) -> list[bytes]:
        """Encodes many parts as one text; no token reaches over a joint, so their ids are cut apart by width."""
        out: list[bytes] = []
        for first in range(0, len(parts), 2000):
            some = parts[first : first + 2000]
            text = b" " + b" ".join(some)
            found = np.frombuffer(self.ids([text.decode("utf-8", "replace")])[0], "<u4")
            ends = np.cumsum([len(p) + 1 for p in some])
            cuts = np.searchsorted(np.cumsum(self.width[found]), ends) + 1
            raw, cuts = found.tobytes(), [0, *(4 * cuts).tolist()]
            out += map(raw.__getitem__, map(slice, cuts, cuts[1:]))
        return out

    def learned(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct parts. A tail is encoded behind the word ``a``, whose ids are dropped."""
        word = [p.isalpha() for p in parts]
        made = [p for p, w in zip(parts, word, strict=True) if not w and p not in self]
        if len(self) + len(made) > self.cached // 2:
            self.clear()
            made = [p for p, w in zip(parts, word, strict=True) if not w]
        ends = [m.end() if m else len(p) for p, m in zip(made, map(WORD.match, made), strict=True)]
        heads = [p[:e] for p, e in zip(made, ends, strict=True)]
        tails = [p[e:] for p, e in zip(made, ends, strict=True)]
        needed = {*compress(parts, word), *heads}
        new = needed.difference(self.words)
        if len(self.words) + len(self.tails) + len(new) > self.cached:
            self.words, self.tails, new = {}, {}, needed
        self.words.update(zip(new, self.coded(list(new)), strict=True))
        after = list(set(tails).difference(self.tails))
        self.tails.update(zip(after, [x[self.lead :] for x in self.coded([b"a" + t for t in after])], strict=True))
        self.update(zip(made, [self.words[h] + self.tails[t] if t else self.words[h] for h, t in zip(heads, tails, strict=True)], strict=True))
        words = self.words
        return [words[p] if w else self[p] for p, w in zip(parts, word, strict=True)]

    def ids(self, texts: list[str]) -> list[bytes]:
        coded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in coded]

    def flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text begins and ends in it; equal to those of the library.

        Texts in which every space is a joint are split and their parts told apart by Arrow; Python sees distinct parts.
        """
        column = pa.array(texts, pa.large_binary())
        special = pc.match_substring(column, self.special[0]) if self.special else pa.array([False] * len(texts))
        for s in self.special[1:]:
            special = pc.or_(special, pc.match_substring(column, s))
        special = special.to_numpy(zero_copy_only=False)
        plain = ~special & ~pc.match_substring_regex(column, UNJOINED).to_numpy(zero_copy_only=False)
        begin, end, out, size = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [], 0
        for some in (np.flatnonzero(plain), np.flatnonzero(~plain)):
            if not len(some):
                continue
            if plain[some[0]]:
                split = pc.split_pattern(column.take(pa.array(some)), pattern=b" ")
            else:
                split = pa.array([[texts[k]] if special[k] else JOINT.split(texts[k]) for k in some], pa.list_(pa.large_binary()))
            ids, ends = self._joined(split)
            begin[some], end[some] = size + np.concatenate([[0], ends[:-1]]), size + ends
            out.append(ids)
            size += len(ids)
        return np.concatenate(out) if out else np.zeros(0, "<u4"), begin, end

    def _joined(self, split: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lists of parts, one after another, and where those of each list end. No list is empty."""
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = split.flatten().dictionary_encode()
        unit = coded.indices.to_numpy().astype(np.int64)
        heads = coded.dictionary.take(pa.array(unit[offsets[:-1]])).to_pylist()  # no space stands before them
        unit[offsets[:-1]] = -1
        used = np.zeros(len(coded.dictionary), bool)
        used[unit[unit >= 0]] = True
        number = np.cumsum(used) - 1
        unit = np.where(unit >= 0, number[unit], 0)
        unit[offsets[:-1]] = used.sum() + np.arange(len(heads))
        distinct = coded.dictionary.filter(pa.array(used))
        _, cuts, raw = distinct.buffers()
        cuts = np.frombuffer(cuts, np.int64)[distinct.offset : distinct.offset + len(distinct) + 1].tolist() if len(distinct) else [0]
        parts = list(map((raw.to_pybytes() if raw else b"").__getitem__, map(slice, cuts, cuts[1:])))
        held = [*self.learned(parts), *self.ids([h.decode("utf-8", "replace") for h in heads])]
        length = np.fromiter(map(len, held), np.int64, len(held)) // 4
        ids = np.frombuffer(b"".join(held), "<u4")
        start, taken = np.cumsum(length) - length, length[unit]
        ends = np.cumsum(taken)
        at = np.repeat(start[unit] - (ends - taken), taken)
        at += np.arange(len(at))
        return ids[at], ends[offsets[1:] - 1]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts, one by one."""
        ids, begin, end = self.flat(texts)
        return [ids[a:b].tobytes() for a, b in zip(begin, end, strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, cap: int = CAP, end_id: int = END_ID, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every piece: its document, number, ids before it, length, checksum of its ids, and the ids if wanted.

    A document is its ids and the end id; only longer ones are cut, into pieces of ``cap`` ids of which the first takes
    what is left over. Null and empty texts are one piece of the end id.
    """
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * cap

    def run(batches):
        tool = encoder(path)
        for batch in gathered(batches, size=AT_ONCE):
            out: list[list] = [[], [], [], [], [], []]
            coded, *ends = tool.flat(byte_texts(batch))
            for doc, first_id, last_id in zip(batch.column(0).to_pylist(), *ends, strict=True):
                whole = coded[first_id:last_id].tobytes() + end
                first = len(whole) % step or step
                cuts = [0, *range(first, len(whole) + 1, step)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, x in zip(out, (doc, k, a // 4, (b - a) // 4, zlib.crc32(whole[a:b]), whole[a:b] if ids else None), strict=True):
                        column.append(x)
            arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in out[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    texts = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text")
    return texts.mapInArrow(run, PIECES + (", ids array<int>" if ids else ""))


def fullest(open_: dict[int, int], room: int) -> dict[int, int]:
    """The combination of open lengths with the largest sum up to ``room``; long pieces are preferred."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in open_ if x <= room), reverse=True):
        left, copies, before = min(open_[length], room // length), 1, reach
        while left > 0:
            copies = min(copies, left)
            reach |= reach << (length * copies)
            left, copies = left - copies, copies * 2
        reach &= mask
        steps.append((length, before))
        if reach >> room & 1:
            break
    goal, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> goal & 1:
            goal -= length
            chosen[length] = chosen.get(length, 0) + 1
    return chosen


def plan(counts: dict[int, int], cap: int = CAP) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first number, copies in a bin, first bin, offset of the first copy), in order of length and number.

    The piece of a length with number n from the first number on goes to bin ``first bin + (n - first) // copies``.
    """
    open_, used, bins, rows = {x: n for x, n in counts.items() if n}, dict.fromkeys(counts, 0), 0, []
    while open_:
        longest = max(open_)
        rest = {x: n - (x == longest) for x, n in open_.items() if n > (x == longest)}
        chosen = fullest(rest, cap - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times, offset = min(open_[x] // n for x, n in chosen.items()), 0
        for length in sorted(chosen, reverse=True):
            rows.append((length, used[length], chosen[length], bins, offset))
            offset += length * chosen[length]
            used[length] += times * chosen[length]
            open_[length] -= times * chosen[length]
            if not open_[length]:
                del open_[length]
        bins += times
    return sorted(rows)


def pack(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """The pieces with sequence_id and offset; no sequence has more than ``cap`` tokens, none a gap.

    ``rows`` has a ``length`` between 1 and ``cap``; other columns are kept. Written to the shared folder once, so that
    pieces are numbered within the same partitions on every read.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    kept = rows.withColumn("_part", F.spark_partition_id()).checkpoint()
    counted = kept.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # <= cap rows
    table = np.array(plan(histogram, cap), np.int64).reshape(-1, 5)
    keys = table[:, 0] << np.int64(44) | table[:, 1]
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("_part", "length").orderBy(*[c for c in ("doc_id", "piece") if c in rows.columns] or ["length"])
    numbered = (
        kept.withColumn("_row", F.row_number().over(inside))
        .join(starts, ["_part", "length"])
        .select(*rows.columns, (F.col("_from") + F.col("_row") - 1).alias("_number"))
    )

    names = [*rows.columns, "sequence_id", "offset"]

    def place(batches):
        for batch in batches:
            number = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, length << np.int64(44) | number, side="right") - 1] if len(length) else table[:0]
            at = number - row[:, 1]
            bin_, offset = row[:, 3] + at // row[:, 2], row[:, 4] + at % row[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bin_), pa.array(offset)], names=names)

    schema = rows.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    return numbered.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed pieces (made with ``ids=True``) put together; a group has at most ``cap`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
