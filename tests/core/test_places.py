"""Places of quotes by automata and by joined words, exports, and medians, against plain loops."""

import random

import pytest

from spanforge.operators import evidence, records, report


def corpus(rng):
    words = ["river", "stone", "of", "the", "light", "é", "中", "over."]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(80)] + [(None, "no id of the river stone light"), (900, None), (901, ""), (5, "repeated id of the light over. stone")]
    quotes = []
    for i in range(60):
        t = rng.choice([d[1] for d in docs if d[1]])
        a = rng.randrange(len(t))
        quotes.append((i, t[a : a + rng.choice([1, 5, 20, 45, 90])]))
    return docs, [*quotes, (100, ""), (101, None), (102, "never written"), (103, quotes[0][1])]


@pytest.mark.parametrize("size, blocks", [(evidence.BLOCK_BYTES, 4), (400, 1000), (400, 0)])
def test_places_equal_contains(spark, monkeypatch, size, blocks):
    monkeypatch.setattr(evidence, "BLOCK_BYTES", size)
    monkeypatch.setattr(evidence, "BLOCKS", blocks)
    docs, quotes = corpus(random.Random(8))
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(quotes, "quote_id long, quote string")
    got = sorted(((r.quote_id, r.doc_id) for r in evidence.places(q, d, "quote_id", "doc_id").collect()), key=str)
    wanted = [(i, j) for i, t in quotes for j, text in docs if t is not None and text is not None and t in text]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert evidence.places(q.limit(0), d, "quote_id", "doc_id").count() == evidence.places(q, d.limit(0), "quote_id", "doc_id").count() == 0


def test_exports_by_compatibility_form(spark):
    df = spark.createDataFrame([(["the ﬁrst line", "２０２５", "lost", None], "The report: the first\n line, 2025."), (None, "x"), (["a"], None)], "parts array<string>, export string")
    assert [r[0] for r in df.select(report.omitted_text(df["parts"], df["export"])).collect()] == [["lost"], None, ["a"]]


def test_upper_medians(spark):
    rng = random.Random(2)
    rows = [(k, c, rng.choice([None, "x" * rng.randint(0, 9)])) for k in range(4) for c in "ab" for _ in range(rng.randint(1, 9))]
    got = {(r.k, r.c): r.width for r in records.column_widths(spark.createDataFrame(rows, "k int, c string, t string"), "k", "c", "t").collect()}
    for key in got:
        sizes = sorted(len(t or "") for k, c, t in rows if (k, c) == key)
        assert got[key] == max(1, sizes[len(sizes) // 2])


def test_the_export_check_reads_chunks_and_no_documents(spark, tmp_path):
    """Whole documents gathered in a row filled a worker's Arrow batches with texts."""
    from spanforge.plans import catalogue_records as records

    spark.createDataFrame([(1, "a" * 1600 + "b" * 1600 + "a" * 9), (2, "c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = records.export_omissions(spark, str(tmp_path))
    assert "collect_list" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 0)]
