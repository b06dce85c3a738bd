"""Suspicious segments of a text, scored inside the row: no explode, no shuffle."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailscore import constants as c
from mailscore.functions.text import contained_words, contains_any, portable, ws_trim


def split_segments(text: Column) -> Column:
    """Sentences and lines longer than ten characters."""
    pieces = F.transform(F.split(text, c.SEGMENT_SPLIT_RE, -1), ws_trim)
    kept = F.filter(pieces, lambda s: F.length(s) > c.SEGMENT_MIN_CHARS)
    return F.coalesce(kept, F.array().cast("array<string>"))


def clues(lowered: str) -> dict[str, Column]:
    """What a whole text holds: its keywords, whether it may hold links, which patterns may match.

    A segment holds no more than its text, so segments are only searched for
    what was found here.
    """
    found = {
        "keywords": contained_words(lowered, c.URGENT_KEYWORDS),
        "links": F.expr(f"contains({lowered}, '://') OR contains({lowered}, 'www.')"),
    }
    for i, literals in enumerate(c.SEGMENT_PATTERN_LITERALS):
        found[f"pattern{i}"] = contains_any(lowered, literals) == 1
    return found


def _facts(clue: dict[str, Column]):
    def facts(s: Column) -> Column:
        low = s["low"]
        may_link = clue["links"] & (F.contains(low, F.lit("://")) | F.contains(low, F.lit("www.")))
        links = F.when(may_link, F.regexp_count(s["segment"], F.lit(c.URL_RE))).otherwise(F.lit(0))
        matched = []
        for i, (pattern, reason) in enumerate(c.SEGMENT_PATTERNS):
            held = reduce(or_, [F.contains(low, F.lit(w)) for w in c.SEGMENT_PATTERN_LITERALS[i]])
            may_match = clue[f"pattern{i}"] & held
            matched.append(F.when(may_match & F.rlike(low, F.lit(portable(pattern))), F.lit(reason)))
        return F.struct(
            s["pos"].alias("pos"),
            s["segment"].alias("segment"),
            F.filter(clue["keywords"], lambda k: F.contains(low, k)).alias("keywords"),
            links.alias("links"),
            F.array_compact(F.array(*matched)).alias("patterns"),
        )

    return facts


def _risk(f: Column) -> Column:
    keywords = F.least(F.size(f["keywords"]), F.lit(c.SEGMENT_KEYWORD_MAX)) * F.lit(c.SEGMENT_KEYWORD_WEIGHT)
    links = F.least(f["links"], F.lit(c.SEGMENT_LINK_MAX)) * F.lit(c.SEGMENT_LINK_WEIGHT)
    steps = [
        F.when(F.size(f["patterns"]) > i, F.lit(c.SEGMENT_PATTERN_WEIGHT)).otherwise(F.lit(0.0))
        for i in range(len(c.SEGMENT_PATTERNS))
    ]
    return F.least(reduce(add, [keywords, links, *steps]), F.lit(1.0))


def _reasons(f: Column) -> Column:
    before, after = c.SEGMENT_LINK_REASON
    listed = F.concat(F.lit(c.SEGMENT_KEYWORD_REASON), F.array_join(F.slice(f["keywords"], 1, 3), ", "))
    counted = F.concat(F.lit(before), f["links"].cast("string"), F.lit(after))
    own = F.array(F.when(F.size(f["keywords"]) > 0, listed), F.when(f["links"] > 0, counted))
    return F.concat(F.array_compact(own), f["patterns"])


def scored_segments(text: Column, clue: dict[str, Column]) -> Column:
    """array<struct<neg_score, pos, text, score, reasons>> of the segments worth showing, in text order.

    ``clue`` names the columns that hold the :func:`clues` of the text.
    """
    patterns = reduce(add, [clue[f"pattern{i}"].cast("int") for i in range(len(c.SEGMENT_PATTERNS))])
    hopeless = (F.size(clue["keywords"]) == 0) & ~clue["links"] & (patterns < 2)
    pieces = F.when(hopeless, F.array().cast("array<string>")).otherwise(split_segments(text))
    segments = F.transform(
        pieces, lambda s, i: F.struct(i.alias("pos"), s.alias("segment"), F.lower(s).alias("low"))
    )
    facts = F.transform(segments, _facts(clue))
    # only these can reach the keep score: a keyword, a link, or two patterns
    facts = F.filter(
        facts, lambda f: (F.size(f["keywords"]) > 0) | (f["links"] > 0) | (F.size(f["patterns"]) > 1)
    )
    risks = F.transform(facts, lambda f: F.struct(_risk(f).alias("risk"), f.alias("f")))
    risks = F.filter(
        risks,
        lambda r: (r["risk"] >= c.SEGMENT_KEEP_SCORE) | (F.size(r["f"]["keywords"]) > 0) | (r["f"]["links"] > 0),
    )

    def shown(r: Column) -> Column:
        segment = r["f"]["segment"]
        cut = F.concat(F.substring(segment, 1, c.SEGMENT_SHOWN_CHARS), F.lit("..."))
        score = F.round(r["risk"] * 100, 1)
        return F.struct(
            (-score).alias("neg_score"),
            r["f"]["pos"].alias("pos"),
            F.when(F.length(segment) > c.SEGMENT_SHOWN_CHARS, cut).otherwise(segment).alias("text"),
            score.alias("score"),
            _reasons(r["f"]).alias("reasons"),
        )

    return F.transform(risks, shown)


def top_segments(scored: Column, k: int = c.SEGMENTS_PER_EMAIL) -> Column:
    """The ``k`` highest scores; equal scores keep text order."""
    return F.slice(F.array_sort(scored), 1, k)


def severity(score: Column) -> Column:
    return (
        F.when(score >= c.SEVERITY_HIGH, F.lit("HIGH"))
        .when(score >= c.SEVERITY_MEDIUM, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )
