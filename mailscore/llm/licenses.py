"""License scan with a positional index of rare template words, in DataFrame functions only.

How many documents hold a word of the templates is counted over all documents. Of every template the words with the
highest inverse document frequency are posted with their positions. The rarest of them are its anchors, as many as it
takes for the others to weigh less than the share that a template has to reach: where a template holds, an anchor is in
place. So a text is looked up under the anchors that it holds; word place minus template place is where the template
would begin, and at each such place the other posted words are looked for at their relative positions. Only the templates
that reach their share are verified, last, by their mandatory phrases. There is no cap on words, places or templates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: phrases that the contract names, with their labels
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# fixed values: label, wording, mandatory phrases
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ("apache license version 2", "in compliance with the license")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license", ("under the terms of the gnu general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3", "under the terms of the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included",)),
    ("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("apache org licenses license 2 0", "distributed under the license")),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3 of the license")),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2 of the license")),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form must reproduce",)),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("a copy of the mpl was not distributed",)),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
POSTED = 6  # rarest words of a template in the index; of a long one every sixth word
SHARE = 0.6  # of a template's weight that has to stand in place
TEMPLATE = 1 << 40  # a beginning is known by template number * TEMPLATE + MOST + place
MOST = 1 << 10  # no template has so many words
KELVIN = "\u212a"  # the one character beyond ASCII whose lower case is a letter of ASCII


def wrapped(phrase: str) -> str:
    """A phrase as it stands in a normalised text, where every word has a blank on either side."""
    return "".join(f" {w} " for w in phrase.split())


def normalised(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``_norm`` (every word between two blanks of its own) and ``_words``; of ASCII only A to Z change."""
    ascii_lower = F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(KELVIN), F.lit("\u0138")))
    core = F.trim(F.regexp_replace(ascii_lower, SEPARATORS, "  "))
    docs = docs.withColumn("_core", core)
    return docs.withColumn("_words", F.when(F.col("_core") != "", F.split("_core", "  ")).otherwise(F.array().cast("array<string>"))).withColumn(
        "_norm", F.when(F.col("_core") != "", F.concat(F.lit(" "), "_core", F.lit(" "))).otherwise("")
    )


def vocabulary() -> list[str]:
    return sorted({w for _, text, _ in TEMPLATES for w in text.split()})


def document_frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows, and for every template word the rows that hold it."""
    words = F.array(*map(F.lit, vocabulary()))
    held = normalised(docs.select("text"), "text").select(F.explode(F.array_append(F.array_intersect(words, "_words"), F.lit(""))).alias("word"))
    found = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}  # the vocabulary
    return found.pop("", 0), found


@dataclass(frozen=True)
class Template:
    """Posted words from rare to frequent as (word, position, weight), how many of them are anchors, the weight needed."""

    posted: list[tuple[str, int, int]]
    anchors: int
    need: int

    @property
    def weight(self) -> int:
        return sum(x for _, _, x in self.posted)


def index(rows: int, frequencies: dict[str, int]) -> list[Template]:
    """The posted words of every template; weights are whole thousandths, so that sums are exact in any order."""
    weight = {w: 1 + round(1000 * math.log((rows + 1) / (frequencies.get(w, 0) + 1))) for w in vocabulary()}
    out = []
    for _, text, _ in TEMPLATES:
        words = text.split()
        places = sorted(enumerate(words), key=lambda p: (-weight[p[1]], p[0]))[: max(POSTED, len(words) // POSTED)]
        posted = [(w, q, weight[w]) for q, w in places]
        left = sum(x for _, _, x in posted)
        need, anchors = math.ceil(SHARE * left), 0
        while left >= need:
            left -= posted[anchors][2]
            anchors += 1
        out.append(Template(posted, anchors, need))
    return out


def _beginnings(templates: list[Template]) -> Column:
    """Where templates would begin by the anchors that the text holds: distinct, by number and place."""
    postings: dict[str, list[int]] = {}
    for t, template in enumerate(templates):
        for w, q, _ in template.posted[: template.anchors]:
            postings.setdefault(w, []).append(t * TEMPLATE + MOST - q)
    table = F.create_map(*[x for w, at in postings.items() for x in (F.lit(w), F.array(*[F.lit(a).cast("long") for a in at]))])
    held = F.array_intersect(F.array(*map(F.lit, postings)), "_words")

    def begun(mine):
        found = F.transform("_words", lambda w, i: F.when(F.array_contains(mine, w), F.transform(F.element_at(table, w), lambda at: at + i)))
        return F.when(F.size(mine) > 0, F.flatten(F.array_compact(found))).otherwise(F.array().cast("array<bigint>"))

    # an array of one: its lambda takes the words held, where the inner one would work them out for every word
    return F.array_distinct(F.flatten(F.transform(F.array(held), begun)))


def _aligned(templates: list[Template]) -> Column:
    """(template number, weight in place) of the beginnings at which a template reaches the weight that it needs."""
    posted = F.array(*[F.array(*[F.struct(F.lit(w).alias("w"), F.lit(q).alias("q"), F.lit(x).alias("x")) for w, q, x in t.posted]) for t in templates])
    need = F.array(*[F.lit(t.need) for t in templates])

    def weighed(beginning):
        t = F.floor(beginning / TEMPLATE).cast("int")
        at = (beginning % TEMPLATE - MOST).cast("int")
        in_place = F.aggregate(F.element_at(posted, t + 1), F.lit(0), lambda sum_, p: sum_ + F.when(F.get("_words", at + p["q"]) == p["w"], p["x"]).otherwise(0))
        return F.struct(t.alias("t"), in_place.alias("s"))

    return F.filter(F.transform(_beginnings(templates), weighed), lambda x: x["s"] >= F.element_at(need, x["t"] + 1))


def _verified(t: Column) -> Column:
    """Whether all mandatory phrases of template number ``t`` stand in the text; the others are not searched for."""
    said = [reduce(and_, [F.contains("_norm", F.lit(wrapped(p))) for p in phrases]) for _, _, phrases in TEMPLATES]
    return reduce(lambda case, k: case.when(t == k, said[k]), range(1, len(said)), F.when(t == 0, said[0])).otherwise(F.lit(False))


def _places(phrase: str) -> Column:
    """How often a phrase stands in the text; two places of a phrase never overlap, as none begins inside itself."""
    n = len(wrapped(phrase))
    less = F.length(F.replace(F.col("_norm"), F.lit(wrapped(phrase)), F.lit("")))
    return F.when(F.contains("_norm", F.lit(wrapped(phrase))), F.floor((F.length("_norm") - less) / n)).otherwise(F.lit(0)).cast("long")


def _word_at(before: Column) -> Column:
    """Number of words in a normalised beginning of a text."""
    return F.floor((F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))) / 2).cast("long")


def _first(phrase: str) -> Column:
    p = F.lit(wrapped(phrase))
    return F.when(F.contains("_norm", p), _word_at(F.substring_index("_norm", wrapped(phrase), 1)))


def _last(phrase: str) -> Column:
    p = F.lit(wrapped(phrase))
    tail = F.length(F.substring_index("_norm", wrapped(phrase), -1)) + len(wrapped(phrase))
    return F.when(F.contains("_norm", p), _word_at(F.substring(F.col("_norm"), F.lit(1), F.length("_norm") - tail)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    ``score`` is the largest share of a template's indexed weight that stands in place with its mandatory phrases, 1 where
    a base phrase stands. Null and empty texts have no words, no labels and score 0; repeated rows give repeated results;
    other columns are ignored. Everything is worked out within the row: nothing is shuffled but the counts of the words.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    templates = index(*document_frequencies(rows))
    seen = normalised(rows, "text").drop("text", "_core")
    seen = seen.withColumn("_n", F.array(*[_places(p) for p, _ in BASE]))
    any_base = F.exists("_n", lambda x: x > 0)
    # labels and score each take _hold once, so that a filter on them pushed below works nothing out over and over
    found = seen.withColumn("_hold", F.filter(_aligned(templates), lambda x: _verified(x["t"])))
    names = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])
    whole = F.array(*[F.lit(t.weight) for t in templates])
    labels = F.transform("_hold", lambda x: F.element_at(names, x["t"] + 1))
    base = F.array_compact(F.array(*[F.when(F.col("_n")[i] > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]))
    top = F.array_max(F.concat(F.array(F.lit(0.0)), F.transform("_hold", lambda x: x["s"] / F.element_at(whole, x["t"] + 1))))
    return found.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_base"),
        F.when(any_base, F.least(*[_first(p) for p, _ in BASE])).alias("first_word"),
        F.when(any_base, F.greatest(*[_last(p) for p, _ in BASE])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, labels)), ",").alias("labels"),
        F.when(any_base, F.lit(1.0)).otherwise(top).alias("score"),
    )
