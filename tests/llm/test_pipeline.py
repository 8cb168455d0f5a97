"""The pipeline's stages against plain rules on a small planted corpus."""

import random

import corpus_pipeline as cp


def test_pipeline(spark, tmp_path):
    rnd = random.Random(5)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    text = lambda n: " ".join(rnd.choices(words, k=n)).capitalize() + "."
    question = text(30)
    docs, labels = [], []
    for i in range(400):
        good = i % 5 != 4
        docs.append((i, text(rnd.randint(30, 90)) if good else "BUY!! NOW!! " * 30, "en", "hot" if i % 3 else f"s{i % 7}"))
        if i % 2:
            labels.append((i, int(good), 0))
    docs += [(1000 + i, docs[i][1], "en", "copy") for i in range(20) if i % 5 != 4]
    docs += [(2000 + i, docs[i][1][:-1] + " extra.", "en", "near") for i in range(20) if i % 5 != 4]
    docs += [(3000, text(40) + " " + question, "en", "hot"), (3001, text(40) + " password=abcdefgh1234 " + text(5), "en", "hot"), (3002, None, "en", None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in cp.run(spark, str(tmp_path)).collect()}
    good = {r[0] for r in docs if r[0] < 400 and r[0] % 5 != 4}
    assert len(good - set(out)) <= 0.03 * len(good) and not {i for i in range(400) if i % 5 == 4} & set(out)
    assert not {d for d in out if 1000 <= d < 3000} and 3000 not in out
    assert "[SECRET]" in out[3001].text and "abcdefgh1234" not in out[3001].text and out[3001].n_chars == len(out[3001].text)
    assert all(out[d].text == t for d, t, *_ in docs if d in good & set(out)) and min(r.copies for r in out.values()) == 1


def test_a_contaminated_row_does_not_take_others_of_its_id_along(spark, tmp_path):
    question = " ".join(f"word{chr(97 + i)}" for i in range(20))
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"so {question} it goes"), (None, "a clean text"), (None, None), (5, question), (5, "another clean text"), (6, "clean")]
    out = cp.drop_benchmark(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [rows[1], rows[2], rows[4], rows[5]]))


def tables(spark, folder, docs, labels=(), benchmark=()):
    schema = "doc_id long, text string, lang string, source string, n_chars long, `__found` string, `__d_copies` int"
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], schema)
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    df.write.parquet(f"{folder}/documents.parquet")
    return df


def test_every_stage_on_nulls_repeats_and_clashing_columns(spark, tmp_path):
    long = "word " * 200_000
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, "some few words of a text", "en", "s", 24), (2, "some few words of a text", "en", "s", 24), (3, long, None, "s", len(long)), (None, "token=abcdefgh1234", "en", None, 18)]
    docs = tables(spark, tmp_path, rows)
    order = lambda out: sorted(str(tuple(r[c] for c in ("doc_id", "source", "n_chars"))) for r in out)
    every = order(docs.collect())
    for _, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert set(docs.columns) <= set(out.columns) and {r["__found"] for r in out.collect()} == {"x"}
        if stage is cp.keep_one_of_each:  # one of the repeated rows with words
            want = list(every)
            want.remove(str((2, "s", 24)))
            assert order(out.collect()) == want
        elif stage is not cp.redact_secrets:
            assert order(out.collect()) == every
        else:
            assert {r.text for r in out.collect()} >= {None, "", "[SECRET]"} and out.where("text = '[SECRET]' and n_chars = 8").count() == 1


def test_every_stage_on_empty_tables(spark, tmp_path):
    docs = tables(spark, tmp_path, [])
    for _, stage in cp.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_tables_of_earlier_stages_are_emptied_and_results_stay(spark, tmp_path):
    from spanforge.llm import common

    rnd = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rnd.choices(words, k=40)), "en", "s", 1) for i in range(60)]
    docs = tables(spark, tmp_path, [*rows, *((100 + i, t, a, b, c) for i, t, a, b, c in rows[:9])])
    before = common.mark(spark)
    first = cp.keep_one_of_each(spark, docs, str(tmp_path))
    held = common.since(spark, before)
    kept = common.materialize(first, "kept")
    second = cp.drop_benchmark(spark, kept, str(tmp_path))
    assert second.count() == 60 and held and not set(held) & set(common.since(spark, 0))
    assert cp.run(spark, str(tmp_path)).count() == 60
