"""Base places against a plain word scan; templates on whole, damaged and unrelated texts."""

import random
import re

from spanforge.llm import licenses as lic
from spanforge.llm import queries as q

LOW = str.maketrans(lic.UPPER, lic.LOWER)
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")"
CASES = [
    None, "", "Released under the MIT License. mit-license MIT License mitlicense", "Licensed under CC BY-NC 4.0. cc\nby, CC BY CC BY SA", "GNU General Public License v3; gnu general publicé license GNU GENERAL PUBLIC  LICENSE",
    "the Apache License, Version 2.0 Kpache İ apache licence apache license", "commit license by cc by by the gnu", MIT, MIT.replace("person", "body").replace("copy of", "copies from"), "permission was granted of charge",
    "GNU Lesser General Public License", "apache license " * 3000,
]


def brute(text):
    w = WORD.findall((text or "").translate(LOW))
    out = []
    for phrase, label in lic.PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), out


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_base_equals_brute_force(spark, tmp_path):
    rows(spark, CASES).withColumn("places", lic.F.lit(0)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in q.op4_licenses(spark, str(tmp_path)).collect()}
    for i, t in enumerate(CASES):
        n, places = brute(t)
        r = got[i]
        assert (r.n_words, r.n_base) == (n, len(places)), i
        assert r.first_word == min((p for p, _ in places), default=None) and r.last_word == max((p for p, _ in places), default=None)
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "mit-text" in got[7].labels and got[7].score == 1 and "mit-text" in got[8].labels and 0.6 <= got[8].score < 1
    assert got[9].labels == "" and got[10].labels == "lgpl" and got[3].labels == "cc-by,cc-by-nc,cc-by-sa"


def test_shapes(spark):
    df = spark.createDataFrame([(None, "mit license", 1), (None, "mit license", 1)], "doc_id long, text string, n_words int")
    assert [(r.n_words, len(r.places)) for r in lic.licenses(df).collect()] == [(2, 1)] * 2
    assert lic.licenses(rows(spark, [])).count() == 0


def test_places_equal_a_plain_scan(spark):
    """Every template, with gaps and other words in it, against a scan of all starts."""
    rnd = random.Random(9)
    texts = []
    for _ in range(150):
        words = rnd.choices(["river", "stone", "license", "software", "public"], k=rnd.randint(0, 30))
        for t in rnd.sample(lic.TEMPLATES, rnd.randint(0, 3)):
            w = list(t.words)
            for _ in range(rnd.choice((0, 0, 1, 4, 9))):
                w[rnd.randrange(len(w))] = "other"
            at = rnd.randint(0, len(words))
            words[at:at] = w
        texts.append(" ".join(words).upper() if rnd.random() < 0.2 else " ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = lic.with_hits(df, "text", lic.TEMPLATES, "n", "seen", "hits")
    weights = lic.idf(table, "seen")

    def brute(text):
        words, out = WORD.findall(text.lower()), []
        for t in lic.TEMPLATES:
            key = t.key.split()
            for s in range(-len(t.words), len(words)):
                if words[max(0, s + t.offset) : s + t.offset + len(key)] != key or s + t.offset < 0:
                    continue
                known = [(i, weights[w]) for i, w in enumerate(t.words) if w in weights]
                share = sum(x for i, x in known if 0 <= s + i < len(words) and words[s + i] == t.words[i]) / sum(x for _, x in known)
                if t.base or share >= 0.6:
                    out.append((t.label, s if t.base else s + t.offset, 1.0 if t.base else round(share, 4)))
        return sorted(out)

    got = {r.doc_id: sorted((p.label, p.start, round(p.score, 4)) for p in r.places) for r in lic.licenses(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)} and sum(map(len, got.values())) > 100


def test_very_many_hits_in_one_text(spark):
    import time

    text = "redistribution and use in source and binary forms with or without modification gnu general public license " * 6000
    began = time.perf_counter()
    got = lic.licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len([p for p in got.places if p.label == "gpl"]) == 6000 and time.perf_counter() - began < 60


def test_key_phrases_of_function_words_and_of_one_word(spark):
    templates = (*lic.TEMPLATES, lic.Template("as-is", "as is", "as is"), lic.Template("one", "copyleft", "copyleft"), lic.Template("only", "what you do with it", "what you do with it"))
    texts = ["sold as is and as is", "a copyleft work", "What you do with it is yours", "as it is", MIT]
    got = {r.doc_id: [(s.label, s.start) for s in r.places] for r in lic.licenses(rows(spark, texts), templates=templates).collect()}
    assert got == {0: [("as-is", 1), ("as-is", 4)], 1: [("one", 1)], 2: [("only", 0)], 3: [], 4: [("mit-text", 0)]}


def test_dotted_names(spark):
    df = rows(spark, ["apache license"]).withColumn("x.y", lic.F.lit(3))
    assert lic.licenses(df).first()["x.y"] == 3
