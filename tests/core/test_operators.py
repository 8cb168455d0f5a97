"""Golden values and invariants of the evidence operators."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import coverage_state, evidence, packing, reading, report, retrieval, review, structure, units
from spanforge.sources import html, ingest


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tokens_and_reference(spark):
    r = one(spark, F.array_sort(T.tokens(F.lit("收入12万A"))), T.tokens(F.concat(F.lit("万"), F.lit(" "))))
    assert r[0] == ["12", "a", "万", "万A", "入", "入1", "收", "收入"] and set(r[1]) == {"万", "万 "}
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit(None).cast("int").alias("page")))
    assert one(spark, T.reference(F.lit("s"), F.lit("v"), spans))[0] == "9bf715f846053fa033748ef25792d48307f59ae9f71cb6519feede7fa4bc7477"
    assert one(spark, T.digest(F.lit('{"a": 1, "b": "中"}')))[0] == "e6f016572ec5bd76309ea02f61ec67f737784d89f31015e842d2a8850da9acb1"
    assert one(spark, T.strip(F.lit("　 x\x1c ")))[0] == "x"


def test_span_text_is_code_points(spark):
    spans = F.expr("array(named_struct('start', 1, 'end', 3), named_struct('start', 3, 'end', 5))")
    assert one(spark, T.span_text(F.lit("a😀b\r\nc"), spans))[0] == "😀b\n\r\n"
    with pytest.raises(Exception, match="span outside"):
        one(spark, T.span_text(F.lit("ab"), F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end")))))


def test_html_blocks():
    page = "<body><nav>skip</nav><h1>Head</h1><p>One <b>bold</b> two</p>bare<table><tr><th>Period</th><th>Revenue</th></tr><tr><td>2025</td><td>12</td></tr></table><script>x</script><p>Last</p></body>"
    assert html.blocks(page) == [("heading", "Head"), ("paragraph", "One bold two"), ("paragraph", "bare"), ("table", "Period | Revenue\n2025 | 12"), ("paragraph", "Last")]
    nested = "<body><table><tr><td><h2>Article</h2><p>Context.</p><table><tr><td>Period</td><td>Value</td></tr><tr><td>2025</td><td>12</td></tr></table><p>Qualification.</p></td></tr></table></body>"
    assert [t for _, t in html.blocks(nested)] == ["Article", "Context.", "Period | Value\n2025 | 12", "Qualification."]
    assert html.blocks("<!doctype html><h1>T</h1><p>x</p>")[0] == ("paragraph", "html")
    assert html.blocks(None) == [] and html.blocks("<div>" * 2000) == []


def test_fusion_counts_a_branch_once(spark):
    lex = spark.createDataFrame([(1, "A", 1), (1, "B", 2)], "query_id int, k string, rank int")
    dense = spark.createDataFrame([(1, "B", 1), (1, "B", 2), (1, "C", 3)], "query_id int, k string, rank int")
    got = {r.k: r.rrf for r in retrieval.fuse({"lexical": lex, "dense": dense}, ["k"]).collect()}
    assert got == pytest.approx({"B": 1 / 62 + 1 / 61, "A": 1 / 61, "C": 1 / 63}, abs=1e-12)


def test_lexical_scope_and_ties(spark):
    p = spark.createDataFrame([("s", "c2", 0, "alpha"), ("s", "c10", 0, "alpha"), ("r", "c1", 5, "alpha beta")], "source_id string, chunk_id string, start_at int, chunk_text string")
    q = spark.createDataFrame([(1, "Alpha", "s")], "query_id int, query string, only string")
    assert [(r.chunk_id, r.rank) for r in retrieval.lexical(p, q).orderBy("rank").collect()] == [("c10", 1), ("c2", 2), ("c1", 3)]
    assert {r.source_id for r in retrieval.lexical(p, q, scope="only").collect()} == {"s"}


def test_table_chunks_repeat_the_header(spark):
    text = "Units: millions\n" + "\n".join(f"row {i} " + "x" * 30 for i in range(3)) + "\n\nlast"
    df = spark.createDataFrame([(1, text), (2, "only a header")], "k int, text string")
    got = [r.chunk_text for r in structure.table_chunks(df, "k", "text", 40).orderBy("k", "chunk_no").collect()]
    assert got[-1] == "only a header" and all(c.startswith("Units: millions\n") and len(c) <= 40 for c in got[:-1])
    assert "".join(c.split("\n", 1)[1] for c in got[:-1]) == "".join(f"row {i} " + "x" * 30 for i in range(3)) + "last"
    with pytest.raises(Exception, match="chunk limit"):
        structure.table_chunks(df, "k", "text", 5).collect()


def test_a_table_piece_takes_its_own_row_only(spark):
    """Each piece was cut from the whole text, which went along with it: the square of a table's length."""
    ends = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    mixed = "Head" + "".join(f"{e}row {i} é😀" + "y" * 25 for i, e in enumerate(ends)) + "\n\n\r\nlast"
    plain = "Head\n\nrow é😀" + "y" * 25 + "\nlast\n"
    df = spark.createDataFrame([(1, mixed), (2, plain), (3, "\nfirst is empty"), (4, None), (5, "")], "k int, text string")
    out = structure.table_chunks(df, "k", "text", 20)
    want = []
    for k, text in ((1, mixed), (2, plain), (3, "\nfirst is empty")):
        rows, at, n = text.splitlines(keepends=True), 0, 0
        room = 20 - len(rows[0].rstrip("\n")) - 1
        for i, row in enumerate(rows):
            bare = row.rstrip("\n")
            for p in range(0, len(bare) if i else 0, room):
                want.append((k, n, f"c{n}", at + p, at + min(p + room, len(bare)), rows[0].rstrip("\n") + "\n" + bare[p : p + room]))
                n += 1
            at += len(row)
    assert [tuple(r) for r in out.orderBy("k", "chunk_no").collect()] == want
    assert "substr(text" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_visual_paragraphs(spark):
    box = [[10, 0, 110, 10], [10, 12, 112, 22], [10, 24, 60, 34], [10, 80, 110, 90], [200, 92, 300, 102]]
    rows = [(1, i, "paragraph", 1, [float(x) for x in b], "ends." if i == 2 else "goes on") for i, b in enumerate(box)]
    df = spark.createDataFrame(rows, "s int, n int, kind string, page int, bbox array<double>, text string")
    got = structure.with_groups(df, "s", "n", structure.same_paragraph(F.col("previous"), F.col("this"))).orderBy("n").collect()
    assert [r.group_no for r in got][:3] == [0, 0, 0] or [r.group_no for r in got][:2] == [0, 0]
    assert got[3].group_no > got[2].group_no and got[4].group_no > got[3].group_no


def test_greedy_window_skips_and_goes_on(spark):
    sizes = [30, 50, 40, 5]  # by nearness to the focus (2): itself, 1 and 3, then 0
    at = [sum(sizes[:i]) for i in range(5)]
    u = spark.createDataFrame([(1, i, i, at[i], at[i + 1]) for i in range(4)], "k int, unit_no int, group_no int, start_at int, end_at int")
    f = spark.createDataFrame([(9, 1, 2), (8, 1, 77)], "focus_id int, k int, focus_no int")
    got = {r.focus_id: r for r in reading.windows(u, f, "k", 80, reach=2).collect()}
    assert got[9].units == [0, 2, 3] and got[9].omitted == [1] and got[9].used == 75 and got[9].status == "partial_parent" and got[8].status == "unknown_focus"
    small = {r.focus_id: r.status for r in reading.windows(u, f, "k", 10, reach=1).collect()}
    assert small[9] == "oversized_unit" and {r.status for r in reading.windows(u, f.where("focus_id = 9"), "k", 1000, 2).collect()} == {"complete_window"}


def views_of(spark, text, focus, limit, query="product", identity="Original document", required=False):
    p = F.array(F.struct(F.lit(text).alias("text"), F.lit(0).alias("start_at"), F.lit("paragraph").alias("kind"), F.lit(required).alias("required")))
    found = reading.bounded_views(F.lit(query), F.lit(identity), F.lit(text), reading.view_units(p, F.lit(focus)), limit)
    return spark.range(1).select(found.alias("views")).first().views


def test_bounded_views_never_cut_a_sentence(spark):
    text = "A context sentence. " * 20 + "The subject supplies the product. " + "A qualifier remains. " * 20
    views = views_of(spark, text, text.index("The subject"), 200)
    assert 1 <= len(views) <= 2
    assert all("The subject supplies the product." in v and len(v) + 7 <= 200 for v in views)
    assert views_of(spark, text, text.index("The subject"), 10) == []
    assert views_of(spark, text, 0, 5000) == ["Original document\n" + text]
    assert views_of(spark, text, 10**6, 200) == [] and views_of(spark, text, 0, 200, required=True) == []


def test_bounded_views_take_the_nearest_first(spark):
    text = "".join(f"S{i}xx." for i in range(11))
    views = views_of(spark, text, text.index("S5"), 1 + 6 * 6 + 2, query="q", identity="")
    assert [[int(u[1]) for u in v.split("\n")[1:]] for v in views] == [[3, 4, 5, 6, 7, 8], [2, 3, 4, 5, 6, 7]]


def test_units_cover_everything_within_the_limit():
    rnd = random.Random(1)
    blocks, at = [], 0
    for kind in ("heading", "paragraph", "paragraph", "table", "paragraph"):
        text = "\n".join("cell | " + "y" * rnd.randint(5, 90) for _ in range(6)) if kind == "table" else " ".join("word" * rnd.randint(1, 3) + rnd.choice((".", "")) for _ in range(40)) if kind == "paragraph" else "Title"
        blocks.append({"kind": kind, "section": "Title", "page": None, "text": text, "start_at": at})
        at += len(text) + 2
    found = list(units.pack(blocks, 100))
    seen = {i for u in found for s in u["spans"] for i in range(*s)}
    assert all(len(u["text"]) <= 100 for u in found)
    assert all(b["start_at"] + i in seen for b in blocks for i, c in enumerate(b["text"]) if not c.isspace())
    with pytest.raises(ValueError, match="no room"):
        list(units.pack([{"kind": "table", "text": "h" * 98 + "\nrow", "start_at": 0}], 99))


def stage(**more):
    sizes = {f"r{i}": 10 for i in range(6)}
    b = {"x": packing.Bundle(frozenset(["r0", "r1"]), "q1", "unassessed", "supports"), "y": packing.Bundle(frozenset(["r2"]), "q1", "adequate", "supports"), "z": packing.Bundle(frozenset(["r2", "r3"]), "q2", "adequate", "conflicts")}
    return packing.Stage(sizes, b, {"q1": ("essential", "partial"), "q2": ("optional", "partial")}, **more)


def test_packing():
    assert packing.choose(stage(), 60) == {f"r{i}" for i in range(6)}
    assert packing.choose(stage(), 20) == {"r2", "r3"}  # adequate first, with the bundle that shares its support
    assert packing.choose(stage(), 10) == frozenset({"r4"}) or len(packing.choose(stage(), 10)) <= 1
    assert packing.choose(stage(required=frozenset(["r5"])), 30) == {"r2", "r3", "r5"}
    with pytest.raises(ValueError, match="exceed"):
        packing.choose(stage(required=frozenset(["r5", "r4"])), 15)


def test_evidence_union_and_codec(spark):
    rows = [("a", 1, "x", 1), ("b", 2, "y", 1), ("a", 3, "x", 2)]
    df = spark.createDataFrame(rows, "ref string, seq int, text string, meta int")
    assert sorted(map(tuple, evidence.union_by_ref(df).select("ref", "seq", "text", "meta").collect())) == [("a", 1, "x", 2), ("b", 2, "y", 1)]
    with pytest.raises(Exception, match="two texts"):
        evidence.union_by_ref(df, df.withColumn("text", F.lit("other"))).collect()
    p = spark.createDataFrame([("s", "v", 2, "c1"), ("s", "v", 1, "c0"), ("t", "v", 3, "c0")], "source_id string, version string, seq int, chunk_id string")
    back = evidence.expand(evidence.compact(p)).select(*p.columns)
    assert back.exceptAll(p).isEmpty() and p.exceptAll(back).isEmpty()
    with pytest.raises(Exception, match="conflicting versions"):
        evidence.group_passages(p.unionByName(p.withColumn("version", F.lit("w")))).collect()


def test_review(spark):
    c = ("a", "b")
    rubric = spark.createDataFrame([(1, "a", "Meets", "x"), (1, "b", "Meets", "x"), (2, "a", "Partly meets", "x"), (2, "b", "Meets", "x"), (3, "a", "Meets", "x"), (4, "a", "Meets", "x"), (4, "b", "Meets", "x")], "review_id int, criterion string, rating string, explanation string")
    reviews = spark.createDataFrame([(i, "ready", "all") for i in range(1, 6)], "review_id int, decision string, review_scope string")
    issues = spark.createDataFrame([(4, "material")], "review_id int, severity string")
    got = {r.review_id: r.decision for r in review.assess(rubric, reviews, issues, c).collect()}
    assert got == {1: "ready", 2: "ready with disclosed limitations", 3: "needs revision", 4: "needs revision", 5: "needs revision"}
    raw = spark.createDataFrame([(1, 1, "minor", "conflict", ["o1"]), (1, 2, "material", "missing_evidence", ["o2"]), (1, 3, "material", "missing_evidence", ["o1"]), (1, 4, "material", "explanation", ["o"])], "s int, seq int, severity string, kind string, origins array<string>")
    routed = review.route(raw, ["severity", "kind"], "s").orderBy("seq").collect()
    assert [(r.finding_id, r.action, r.origins) for r in routed] == [("finding-1", "research", ["o1", "o2"]), ("finding-2", "revise", ["o"])]


def test_coverage_updates_are_atomic():
    c = coverage_state.Coverage({"q": coverage_state.Question()}, {"b": ("q", "adequate"), "c": ("q", "unassessed")})
    assert c.apply([{"question_id": "q", "state": "supported", "bundle_ids": ["b"]}, {"question_id": "q", "state": "conflicting", "bundle_ids": ["b"]}])
    assert c.questions["q"].state == "unresolved"
    assert not c.apply([{"question_id": "q", "state": "conflicting", "bundle_ids": ["b", "c"]}]) and c.questions["q"].bundles == ("b", "c")


def test_calculate_and_citations(spark):
    ops = [("divide", "1", "4"), ("add", "0.1", "0.2"), ("divide", "1", "0"), ("multiply", "NaN", "1"), ("divide", "1", "3")]
    df = spark.createDataFrame(ops, "o string, a string, b string")
    assert [r[0] for r in df.select(report.calculate(F.col("o"), F.col("a"), F.col("b"))).collect()] == ["0.25", "0.3", None, None, "0.3333333333333333333333333333"]
    got = one(spark, report.citations(F.lit("as [S2 c45–c47] and [S1 c3]")))[0]
    assert [tuple(x) for x in got] == [("S2", 45, 47), ("S1", 3, 3)]


def test_ingest_publish_and_mutation(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# Head\n\nBody one.\r\nmore\n \n|a|b|\n|1|2|\n", encoding="utf-8")
    (tmp_path / "in/b.html").write_text("<body><h1>T</h1><p>Text</p></body>")
    (tmp_path / "in/c.txt").write_bytes(b"\xff\xfe")
    o = ingest.files(spark, str(tmp_path / "in"))
    rows = ingest.parsed(o)
    assert rows.where("error is not null").count() == 1
    same = {"hash": hashlib.sha256((tmp_path / "in/a.md").read_bytes()).hexdigest(), "origin": "a.md", "parser": ingest.PARSER, "chunker": ingest.CHUNKER, "limit": 1600}
    assert o.where("origin = 'a.md'").first().source_id == hashlib.sha256(ingest.canonical(same).encode()).hexdigest()
    b = ingest.structured(rows).join(o.select("source_id", "origin"), "source_id")
    md = b.where("origin = 'a.md'").orderBy("block_no").collect()
    assert [(r.kind, r.start_at, r.section, r.block_id) for r in md] == [("heading", 0, "# Head", "b0"), ("paragraph", 8, "# Head", "b1"), ("table", 25, "# Head", "b2")]
    texts = ingest.canonical_text(rows)
    assert ingest.validated(texts).count() == 2 and ingest.new_sources(o, o).count() == 0
    with pytest.raises(Exception, match="source changed"):
        ingest.validated(texts.withColumn("text", F.concat("text", F.lit("!")))).collect()
    (tmp_path / "log.jsonl").write_text(json.dumps({"kind": "x", "n": 1}) + "\nbroken\n")
    assert [r.unparsed for r in ingest.events(spark, str(tmp_path / "log.jsonl"), "kind string, n int").orderBy("kind").collect()] == ["broken", None]


def test_the_whole_pool_is_reranked(spark, tmp_path):
    from spanforge.plans import catalogue

    spark.createDataFrame([(i, "river stone " + " ".join(f"w{i}x{k}" for k in range(i + 3))) for i in range(70)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "river stone")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.place for r in catalogue.rerank_blocks(spark, str(tmp_path)).collect()) == list(range(1, 65))


def test_dense_in_one_block_and_in_several(spark):
    rnd = random.Random(4)
    from spanforge.operators import retrieval

    rows = [(i, [float(rnd.randint(-2, 2)) for _ in range(8)], i % 3) for i in range(200)] + [(900, [0.0] * 8, 1), (901, None, 1)]
    v = spark.createDataFrame(rows, "unit_id int, embedding array<double>, scope int").repartition(3)
    q = spark.createDataFrame([(i, rows[i][1], rows[i][2]) for i in range(20)], "query_id int, query_embedding array<double>, query_scope int").where("exists(query_embedding, x -> x <> 0)")
    for scoped in (False, True):
        one, several = (sorted(map(tuple, retrieval.dense(v, q, 7, scoped, 8, block).collect())) for block in (1000, 6))
        assert one == several and len(one) == 7 * q.count()
    assert retrieval.dense(v, q.limit(0), 7, False, 8).count() == 0


def test_packing_keeps_its_promises():
    """On random stages: within the budget, with what is required and the support that hangs on it, and no offer left that fits."""
    rnd = random.Random(12)
    for _ in range(400):
        refs = [f"r{i}" for i in range(rnd.randint(2, 9))]
        bundles = {f"b{i}": packing.Bundle(frozenset(rnd.sample(refs, rnd.randint(1, min(3, len(refs))))), rnd.choice((None, "q1", "q2")), rnd.choice(packing.ADEQUACIES), rnd.choice(("conflicts", "supports"))) for i in range(rnd.randint(0, 6))}
        s = packing.Stage({r: rnd.randint(1, 20) for r in refs}, bundles, {"q1": ("essential", "partial"), "q2": ("optional", "supported")}, frozenset(rnd.sample(refs, rnd.randint(0, 1))), frozenset(refs[:1]), rnd.random() < 0.5)
        limit = rnd.randint(20, 90)
        chosen = packing.choose(s, limit)
        assert s.required <= chosen and s.size(chosen) <= limit
        adequate = [b.refs for b in bundles.values() if b.adequacy == "adequate"]

        def closed(x, adequate=adequate):
            while any(b & x and not b <= x for b in adequate):
                x = x.union(*(b for b in adequate if b & x))
            return x

        if chosen != s.required:
            assert closed(chosen) == chosen
        linked = frozenset().union(*(b.refs for b in bundles.values()))
        for offer in [b.refs for b in bundles.values()] + [frozenset([r]) for r in refs if r not in linked]:
            grown = closed(chosen | offer)
            assert grown == chosen or s.size(grown) > limit


def test_artifacts(spark, tmp_path):
    from spanforge.sources import ingest

    df = spark.createDataFrame([(1, "a"), (2, "b")], "n long, s string")
    ingest.write_artifact(df, f"{tmp_path}/x")
    assert sorted(map(tuple, ingest.artifact(spark, f"{tmp_path}/x", "n long, s string").collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="already exists"):
        ingest.write_artifact(df, f"{tmp_path}/x")
    (tmp_path / "whole.json").write_text('[{"n": 1,\n "s": "a"}]')
    assert [tuple(r) for r in ingest.artifact(spark, f"{tmp_path}/whole.json").collect()] == [(1, "a")]


def test_records_refuse_what_they_must(spark):
    from spanforge.operators import records

    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    chunks = made([("s", "c0", "some text")], "source_id string, chunk_id string, chunk_text string")
    note = made([("s", "n", "absent", "c0")], "source_id string, name string, value string, chunk_id string")
    with pytest.raises(Exception, match="not in its chunk"):
        records.source_context(chunks.select("source_id"), note, chunks).collect()
    with pytest.raises(Exception, match="too many tasks"):
        records.bounded_tasks(made([(1, i) for i in range(13)], "plan int, task int"), "plan").collect()
    files = made([(1, p, p) for p in "abc"], "bundle_id int, path string, body string")
    manifest = files.select("bundle_id", F.lit(1).alias("schema_version"), "path", F.sha2("body", 256).alias("digest"))
    assert records.bundle_import(manifest, files).count() == 3
    for bad, fault in ((manifest.withColumn("schema_version", F.lit(2)), "schema version"), (manifest.where("path <> 'a'"), "not complete"), (manifest.withColumn("digest", F.lit("x")), "bound")):
        with pytest.raises(Exception, match=fault):
            records.bundle_import(bad, files).collect()
    steps = [(1, "call", None, "p"), (2, "initialize", "10", None), (3, "call", None, "p"), (4, "start", None, None), (5, "call", None, "p"), (6, "initialize", "20", None), (7, "disable", None, "p"), (8, "call", None, "p"), (9, "call", None, "q"), (10, "initialize", "10", None)]
    events = made([(0, *s) for s in steps], "ledger_id int, seq int, kind string, limits string, provider string")
    got = [r.problem for r in records.lifecycle(events).orderBy("seq").collect()]
    assert got == ["not initialized", None, "not started", None, None, "other limits", None, "provider disabled", None, None]


def test_sizes_of_packing_are_those_of_the_serialized_objects(spark):
    texts = ["plain", 'q"uo\\te\n\r\t\b\f', "\x01\x02\x1f é 中 \U0001f600", ""]
    df = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)], "ref string, body string")
    got = df.select("ref", "body", packing.serialized("ref", "body").alias("n")).collect()
    assert [r.n for r in got] == [len(json.dumps({"ref": r.ref, "text": r.body}, ensure_ascii=False).encode()) + 2 for r in got]
