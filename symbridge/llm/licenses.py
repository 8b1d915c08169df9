"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

Template tokens are ordered by their frequency in the corpus, rarest first. A block that holds the share `CONTAINMENT` of a
template's tokens must hold one of the template's first `n - need + 1` tokens (prefix filter), at least `need` template tokens
(length filter), and the places of the shared token in both orders must leave room for `need` (positional filter); what is left is
counted exactly. A block is a run of words of the text, whatever its lines, twice as long as the longest run of its templates and starting at
every half, which holds every run whole; templates of at most `MOST_WORDS` words and longer ones, such as whole license texts, have blocks
of their own.

Blocks that are left are looked at run by run, since a statement's words stand together: a run begins with a word of the template and is as
many words as it has, over `containment` (fewer at the end of the text). It is a hit if it holds the share of the template's words, and the same share of its own words, those of no other label's template, so that "released under the GPL
license" is not the MIT statement; and if it holds no word that only a larger template has, of another label and with all of its words, so that
"CC BY-NC" is not "CC BY".

Beside the join, fixed phrases give the base labels with their places.

Defined results: null or empty text: no words, no labels, score 0. Null id: kept as null. Repeated rows: each has its row. Empty table:
no rows. Extra columns are ignored. Templates are at most `MOST_TEMPLATES` with `MOST_TEMPLATE_WORDS` words, which bounds what is broadcast.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbridge.llm.shared import id_in, id_out, materialise, table

CONTAINMENT = 0.8
MOST_WORDS = 32
MOST_TEMPLATES = 1000
MOST_TEMPLATE_WORDS = 100_000

# Base phrases with their labels, and license statements with theirs.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("all-rights-reserved", "All rights reserved."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in
        the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in
        all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
        OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
        USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORD_CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD_CASED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def template_words(text: str) -> list[str]:
    return re.sub(NO_WORD, " ", text.translate(str.maketrans(UPPER, LOWER))).split(" ")


def lowered(text: Column) -> Column:
    """A-Z lower-cased. lower() changes other letters too, but only two of them to something with an ASCII letter."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text.contains("\u212a") | text.contains("\u0130"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def spaced(text: Column) -> Column:
    """The words of a lower-cased text, one space between."""
    return F.trim(F.regexp_replace(text, NO_WORD, " "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def word_count(text: Column) -> Column:
    """Words of a text: each is replaced, with what stands before it, by one character. The letter put at the end closes the text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    marks = F.length(F.regexp_replace(F.concat(text, F.lit("a")), f"{NO_WORD_CASED}*{WORD_CASED}+", "x"))
    return (marks - F.when((text == "") | F.substring(text, -1, 1).rlike(NO_WORD_CASED), 1).otherwise(0)).cast("long")


def holds(low: Column, words: list[str]) -> Column:
    """Whether low contains any of the words; low is evaluated once."""
    return F.exists(F.array(low), lambda x: reduce(Column.__or__, [x.contains(w) for w in words]))


def phrases(docs: DataFrame) -> DataFrame:
    """_id, _key, n_base, first_word, last_word, found (base labels) of the documents with a base phrase."""
    # each word stands between two spaces of its own, so that places of a phrase never share a space
    own = docs.where(holds(F.col("low"), ["license"])).select("_id", "_key", F.concat(F.lit(" "), F.replace(spaced(F.col("low")), F.lit(" "), F.lit("  ")), F.lit(" ")).alias("own"))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        written = "".join(f" {w} " for w in phrase.split())
        n = ((F.length("own") - F.length(F.replace("own", F.lit(written), F.lit("")))) / len(written)).cast("long")
        counts.append(n)
        firsts.append(F.when(n > 0, _spaces(F.substring_index("own", written, 1)) / 2).cast("long"))
        lasts.append(F.when(n > 0, (_spaces(F.col("own")) - _spaces(F.substring_index("own", written, -1))) / 2 - len(phrase.split())).cast("long"))
        labels.append(F.when(n > 0, F.lit(label)))
    found = own.select("_id", "_key", reduce(Column.__add__, counts).alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), F.array_compact(F.array(*labels)).alias("found"))
    return found.where("n_base > 0").distinct()


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many documents each word of a bounded vocabulary stands in."""
    words = docs.select(F.explode(F.array_intersect(F.split("low", NO_WORD), F.array(*map(F.lit, vocabulary)))).alias("word"))
    return {r["word"]: r["count"] for r in words.groupBy("word").count().collect()}  # at most the vocabulary


def run_length(words: list[str], containment: float) -> int:
    """The words of a run that a statement may spread over."""
    return math.ceil(len(words) / containment - 1e-9)


@dataclass(frozen=True)
class Template:
    """A statement's label, words, its own words (of no other label) and the words that only larger statements of other labels have."""

    label: str
    tokens: frozenset[str]
    own: frozenset[str]
    foreign: frozenset[str]
    run: int

    def need(self, containment: float) -> int:
        return math.ceil(containment * len(self.tokens) - 1e-9)

    def need_own(self, containment: float) -> int:
        return math.ceil(containment * len(self.own) - 1e-9)


def prepared(templates: list[tuple[str, str]], containment: float) -> list[Template]:
    words = [(label, [w for w in template_words(t.strip()) if w]) for label, t in templates]
    if not all(ws for _, ws in words):
        raise ValueError("a template has no word")
    held: dict[str, set[str]] = {}
    for label, ws in words:
        for w in ws:
            held.setdefault(w, set()).add(label)
    out = []
    for label, ws in words:
        mine = frozenset(ws)
        larger = [frozenset(o) for other, o in words if other != label and mine < frozenset(o)]
        out.append(Template(label, mine, frozenset(w for w in mine if held[w] == {label}), frozenset().union(*larger) - mine, run_length(ws, containment)))
    return out


def template_table(templates: DataFrame) -> list[tuple[str, str]]:
    """The (label, text) rows of a table of templates, of which there may be MOST_TEMPLATES."""
    return [(r["label"], r["text"]) for r in templates.select("label", "text").limit(MOST_TEMPLATES + 1).collect()]


def similar(docs: DataFrame, templates: list[tuple[str, str]], containment: float = CONTAINMENT) -> DataFrame:
    """_id, _key, labels, score of the documents with a run that is a hit of a template; score is the largest share of its distinct words."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    ready = prepared(templates, containment)
    if sum(len(t.tokens) for t in ready) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"more than {MOST_TEMPLATE_WORDS} words of templates")
    vocabulary = sorted({w for t in ready for w in t.tokens})
    often = frequencies(docs, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}
    ranked = F.create_map(*(F.lit(x) for w in vocabulary for x in (w, rank[w])))
    kinds = []
    for long in (False, True):
        mine = [t for t in ready if (t.run > run_length([""] * MOST_WORDS, containment)) == long]
        index = []
        for t in mine:
            ranks, need = sorted(rank[w] for w in t.tokens), t.need(containment)
            told = (t.label, ranks, need, sorted(t.tokens), sorted(t.own), t.need_own(containment), sorted(t.foreign), t.run)
            index += [(r, place, *told) for place, r in enumerate(ranks[: len(ranks) - need + 1])]
        if mine:
            kinds.append((index, max(t.run for t in mine)))
    of = lambda index: [w for w in vocabulary if rank[w] in {r for r, *_ in index}]
    lead = of([entry for index, _ in kinds for entry in index])
    text = docs.where(holds(F.col("low"), lead)).select("_id", "_key", F.split(spaced(F.col("low")), " ").alias("words")).where(F.arrays_overlap("words", F.array(*map(F.lit, lead))))
    text = materialise(text, "texts") if len(kinds) > 1 else text
    share = reduce(DataFrame.unionAll, [_blocks(text, index, of(index), ranked, vocabulary, run) for index, run in kinds])
    return share.groupBy("_id", "_key").agg(F.collect_set("label").alias("labels"), F.max("share").alias("score"))


POSTING = "token int, t_place int, label string, ranks array<int>, need int, tokens array<string>, own array<string>, need_own int, foreign array<string>, run int"


def _blocks(text: DataFrame, index: list[tuple], lead: list[str], ranked: Column, vocabulary: list[str], run: int) -> DataFrame:
    """_id, _key, label and share of the runs (cut from texts with words) that are hits of templates (index, whose longest run is `run`)."""
    posting = text.sparkSession.createDataFrame(index, POSTING)
    # cut within one row, so that a long text is not copied for each of its blocks; a block that the one before it holds is none
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - run, F.lit(1)), F.lit(run))
    cut = F.transform(starts, lambda at: F.struct((at + 2 * run > F.size("words")).alias("last"), F.slice("words", at, 2 * run).alias("words")))
    own = text.select("_id", "_key", F.explode(cut).alias("b")).select("_id", "_key", "b.last", "b.words").where(F.arrays_overlap("words", F.array(*map(F.lit, lead))))
    held = own.select("_id", "_key", "last", "words", F.sort_array(F.transform(F.array_intersect("words", F.array(*map(F.lit, vocabulary))), lambda w: F.element_at(ranked, w))).alias("held"))
    pairs = held.where(F.size("held") >= min(need for _, _, _, _, need, *_ in index)).select("_id", "_key", "last", "words", "held", F.posexplode("held").alias("place", "token")).join(F.broadcast(posting), "token")
    room = F.least("place", "t_place") + F.least(F.size("held") - F.col("place"), F.size("ranks") - F.col("t_place"))
    near = pairs.where((F.size("held") >= F.col("need")) & (room >= F.col("need")) & (F.size(F.array_intersect("held", "ranks")) >= F.col("need")))
    # a block and a template that share several first tokens are one
    one = near.where(F.col("token") == F.array_min(F.array_intersect("held", "ranks")))
    # whole runs of the block, and shorter ones at the end of the text
    at = F.sequence(F.lit(1), F.when(F.col("last"), F.size("words")).otherwise(F.size("words") - F.col("run") + 1))

    def hit(i: Column) -> Column:
        words = F.slice("words", i, F.col("run"))
        sure = F.array_contains("tokens", F.col("words")[i - 1]) & (F.size(F.array_intersect(words, "own")) >= F.col("need_own")) & ~F.arrays_overlap(words, "foreign")
        return F.when(sure, F.size(F.array_intersect(words, "tokens"))).otherwise(0)

    best = one.select("_id", "_key", "label", "need", F.size("ranks").alias("n"), F.array_max(F.transform(at, hit)).alias("shared"))
    return best.where("shared >= need").select("_id", "_key", "label", (F.col("shared") / F.col("n")).alias("share"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """One row per document with its base phrases, labels and score; templates: (label, text), a list or a table."""
    templates = TEMPLATES if templates is None else template_table(templates) if isinstance(templates, DataFrame) else templates
    key = F.xxhash64(F.col("text").cast("string")).alias("_key")
    rows = docs.select(id_in().alias("_id"), key, lowered(F.col("text")).alias("low"))
    more = similar(rows, templates)
    out = docs.select(id_in().alias("_id"), key, word_count(F.col("text")).alias("n_words")).join(phrases(rows), ["_id", "_key"], "left").join(more, ["_id", "_key"], "left")
    none = F.array().cast("array<string>")
    base, label = F.coalesce("found", none), F.coalesce("labels", none)
    return out.select(
        id_out(F.col("_id")).alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, label)), ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda words: "CAST([" + ", ".join(map(quote, sorted(words))) + "] AS VARCHAR[])"
    templates = ", ".join(f"({quote(t.label)}, {t.run}, {t.need(CONTAINMENT)}, {listed(t.tokens)}, {t.need_own(CONTAINMENT)}, {listed(t.own)}, {listed(t.foreign)})" for t in prepared(TEMPLATES, CONTAINMENT))
    phrases_ = ", ".join(f"({quote(label)}, [{', '.join(map(quote, p.split()))}])" for p, label in PHRASES.items())
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    words = lambda text: f"list_filter(regexp_split_to_array({text}, '{NO_WORD}'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {low} AS low, {words(low)} AS w FROM documents),
templates(label, run, need, tokens, need_own, own, foreigners) AS (VALUES {templates}), phrases(label, tokens) AS (VALUES {phrases_}),
places AS (SELECT doc_id, label, i - 1 AS at_word FROM d, phrases, unnest(range(1, len(w) + 1)) AS t(i) WHERE contains(low, 'license') AND list_slice(w, i, i + len(tokens) - 1) = tokens),
may AS (SELECT doc_id, w, t.* FROM d, templates t WHERE len(list_intersect(list_distinct(w), tokens)) >= need),
runs AS (SELECT doc_id, label, need, tokens, need_own, own, foreigners, list_slice(w, i, i + run - 1) AS r FROM may, unnest(range(1, len(w) + 1)) AS t(i) WHERE list_contains(tokens, w[i])),
hits AS (SELECT doc_id, label, len(list_intersect(list_distinct(r), tokens)) / CAST(len(tokens) AS DOUBLE) AS share FROM runs
    WHERE len(list_intersect(list_distinct(r), tokens)) >= need AND len(list_intersect(list_distinct(r), own)) >= need_own AND NOT list_has_any(r, foreigners)),
found AS (SELECT doc_id, label, max(share) AS share FROM hits GROUP BY 1, 2),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM found UNION SELECT doc_id, label FROM places) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_base, p.a AS first_word, p.b AS last_word, coalesce(p.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, coalesce(f.score, 0.0) AS score
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n, min(at_word) AS a, max(at_word) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY 1) p ON p.doc_id = d.doc_id
LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, max(share) AS score FROM found GROUP BY 1) f ON f.doc_id = d.doc_id
"""


ORACLE = _oracle()
