"""License texts by a positional index of their rarest words, in built-in expressions only.

The index holds the words of the templates. One pass turns each text into its word count, the index
words seen, and their postings ``(word, position)`` where a mandatory phrase may stand; that narrow
table is written once. Document frequencies of the index words over all documents give their IDF.
For each template the words of highest IDF in its mandatory phrase are its anchors: a posting of an
anchor at position p, with offset o in the template, proposes the start p - o. Proposed starts are
intersected with the postings of the phrase's other words at their relative positions, which
verifies it word for word; the IDF-weighted share of the template's words found at theirs is the
coverage, and a label is given if it reaches ``least``. Phrases (the base labels) are templates
whose key phrase is all of them. ``TEMPLATES`` is a starter set: others are given as a parameter.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, free_name, materialize, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    """``key``: mandatory phrase, inside ``text``; both are lower-case words."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def offset(self) -> int:
        w, k = self.words, self.key.split()
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


#: The base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Opening or operative words of public licences.
TEXTS = (
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee"),
    Template("apache-text", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "distributed on an as is basis"),
    Template("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "free software you can redistribute it and or modify it"),
    Template("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license", "gnu affero general public license"),
    Template("mpl", "mozilla public license", "mozilla public license"),
    Template("epl", "eclipse public license", "eclipse public license"),
    Template("bsd", "bsd license", "bsd license"),
    Template("cc-by-nc", "cc by nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd", "cc by nd"),
    Template("cc0", "cc0 1 0 universal", "cc0 1 0 universal"),
    Template("unlicense", "free and unencumbered software released into the public domain", "released into the public domain"),
    Template("zlib-text", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    Template("boost", "boost software license", "boost software license"),
    Template("artistic", "the artistic license", "artistic license"),
    Template("cddl", "common development and distribution license", "common development and distribution license"),
    Template("ofl", "sil open font license", "sil open font license"),
    Template("eupl", "european union public licence", "european union public licence"),
    Template("psf", "python software foundation license", "python software foundation license"),
    Template("ms-pl", "microsoft public license", "microsoft public license"),
    Template("cc-by-text", "creative commons attribution", "creative commons attribution"),
    Template("wtfpl", "do what the fuck you want to public license", "what the fuck you want to public license"),
)
TEMPLATES = (*(Template(label, phrase, phrase, True) for phrase, label in PHRASES), *TEXTS)


def words_of(text: str | Column) -> Column:
    """Lower-case only A-Z; a word is a run of digits, letters and all that is not ASCII."""
    return F.regexp_extract_all(F.translate(text_of(text), UPPER, LOWER), F.lit(WORD), F.lit(0))


NO_PLACES = "cast(array() as array<struct<label:string,start:bigint,score:double,base:boolean>>)"
#: Function words: verified in key phrases, but never anchors, and without weight in a coverage.
FUNCTION = frozenset("a an and any are as at be can do for in is it of on or that the this to under what with without you".split())


def index_words(templates=TEMPLATES) -> list[str]:
    """The words that are indexed in every text; function words only for a key phrase that has no others."""
    return sorted(set().union(*(set(t.words) - FUNCTION for t in templates), *(key_words(t) for t in templates)))


def key_words(t: Template) -> set[str]:
    """Index words of a template's key phrase."""
    words = set(t.key.split())
    return words - FUNCTION or words


def with_hits(docs: DataFrame, text: str, templates, n_words: str, seen: str, hits: str) -> DataFrame:
    """Adds the word count, the index words seen, and the postings ``(w, p)`` of template words, in place of the text.

    Postings, function words among them, are written where some template's mandatory phrase has
    all its index words in the text; elsewhere no template can stand.
    """
    words = free_name(docs, "words")
    index, every = (F.array(*(F.lit(w) for w in ws)) for ws in (index_words(templates), sorted({w for t in templates for w in t.words})))
    split = docs.select(*(column(c) for c in docs.columns if c != text), words_of(text).alias(words))
    split = split.withColumn(seen, F.array_intersect(F.col(words), index))
    keys = sorted({tuple(sorted(key_words(t))) for t in templates})
    stands = F.lit(False)
    for key in keys:
        stands = stands | (F.size(F.array_intersect(F.col(seen), F.array(*map(F.lit, key)))) == len(key))
    at = F.transform(F.col(words), lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("p")))
    posted = F.filter(at, lambda s: F.array_contains(every, s["w"]))
    hit = F.when(stands, posted).otherwise(F.expr("cast(array() as array<struct<w:string,p:bigint>>)"))
    return split.withColumns({n_words: F.size(words).cast("long"), hits: hit}).drop(words)


def idf(table: DataFrame, seen: str, templates=TEMPLATES) -> dict[str, float]:
    """IDF of each index word over all documents. To the driver comes one number per index word."""
    n = table.count()
    found = table.select(F.explode(seen).alias("w")).groupBy("w").count().collect()
    df = {r["w"]: r["count"] for r in found}
    return {w: math.log((n + 1) / (df.get(w, 0) + 0.5)) for w in index_words(templates)}


def starts(hits: Column, t: Template, weights: dict[str, float], least: float, anchors: int = 3) -> Column:
    """Array of ``(label, start, score, base)``: places where a template stands, by the positional index.

    Postings are intersected as sets and shares are summed over sorted matches, so that a text of
    very many hits costs no product of them.
    """
    words, at = t.words, t.offset
    weighty = set(words) - FUNCTION | key_words(t)
    inside = range(at, at + len(t.key.split()))
    # anchors come from the mandatory phrase, so that every place to be found has each of them
    ranked = sorted((i for i in inside if words[i] in weighty), key=lambda i: (-weights[words[i]], i))

    def posting(i: int) -> Column:
        return F.transform(F.filter(hits, lambda s: s["w"] == words[i]), lambda s: s["p"] - i)

    proposed = posting(ranked[0])
    for i in [*ranked[1:anchors], *(i for i in inside if i not in ranked[:anchors])]:
        proposed = F.array_intersect(proposed, posting(i))
    label, base = F.lit(t.label).alias("label"), F.lit(t.base).alias("base")
    beyond = [i for i in range(len(words)) if words[i] in weighty and i not in inside]
    if t.base or not beyond:  # the key phrase is all there is to weigh
        return F.transform(proposed, lambda s: F.struct(label, (s + (0 if t.base else at)).alias("start"), F.lit(1.0).alias("score"), base))
    sure = sum(weights[words[i]] for i in inside if words[i] in weighty)
    total = sure + sum(weights[words[i]] for i in beyond)

    def match(found: Column, w: float) -> Column:
        return F.transform(found, lambda s: F.struct(s.alias("s"), F.lit(w).alias("w")))

    def shares(m: Column) -> Column:
        """Sum of the weights of each start in matches sorted by start."""
        first = lambda i: (i == 0) | (F.get(m, i - 1)["s"] != F.get(m, i)["s"])

        def place(i: Column) -> Column:
            start = F.get(m, i)["s"]
            share = F.aggregate(F.slice(m, i + 1, len(beyond) + 1), F.lit(0.0), lambda a, x: a + F.when(x["s"] == start, x["w"]).otherwise(0.0))
            return F.struct(label, (start + at).alias("start"), F.least(F.round(share / F.lit(total), 6), F.lit(1.0)).alias("score"), base)

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(m) - 1), first), place)

    def weighed(p: Column) -> Column:
        every = F.concat(match(p, sure), *(match(F.array_intersect(p, posting(i)), weights[words[i]]) for i in beyond))
        return F.get(F.transform(F.array(F.array_sort(every)), shares), 0)

    # bound to variables, or starts and matches would be worked out for each element again
    none = F.expr(NO_PLACES)
    out = F.get(F.transform(F.array(proposed), lambda p: F.when(F.size(p) > 0, weighed(p)).otherwise(none)), 0)
    return F.filter(out, lambda s: s["score"] >= least)


def license_places(hits: str, weights: dict[str, float], templates=TEMPLATES, least: float = 0.6) -> Column:
    """Array of ``(label, start, score, base)`` of every place of every template."""
    return F.when(F.size(hits) > 0, F.concat(*(starts(F.col(hits), t, weights, least) for t in templates))).otherwise(F.expr(NO_PLACES))


def licenses(docs: DataFrame, text: str = "text", templates=TEMPLATES, least: float = 0.6) -> DataFrame:
    """``docs`` without ``text``, with ``n_words`` and ``places`` (label, start word, score, base).

    Null and empty texts have 0 words and no places; an empty table stays empty; repeated rows are
    repeated; a place per template and start, so that ties keep all; input columns ``n_words`` or
    ``places`` are replaced.
    """
    n, seen, h = (free_name(docs, x) for x in ("n_words", "seen", "hits"))
    kept = [column(c) for c in docs.columns if c.lower() not in {text.lower(), "n_words", "places"}]
    table = materialize(with_hits(docs, text, templates, n, seen, h).select(*kept, n, seen, h), "licenses")
    weights = idf(table, seen, templates)
    return table.select(*kept, F.col(n).alias("n_words"), license_places(h, weights, templates, least).alias("places"))
