"""Components against all pairs of full sets."""

import random

import pytest
from spanforge.llm import near_dup as nd
from spanforge.llm import queries as q

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = (text or "").translate(LOW).encode().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(sets[i]), low[root(i)], d == low[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    rows = []
    for _ in range(n):
        kind = rnd.random()
        if rows and kind < 0.6:
            words = rnd.choice(rows)[1].split(" ")
            for _ in range(rnd.choice((0, 0, 1, 1, 2, 4))):
                if words:
                    words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            if kind < 0.1:
                words = words[rnd.randint(0, 3) :]
            text = " ".join(words)
        else:
            text = " ".join(rnd.choices(vocabulary, k=rnd.choice((0, 1, 3, 5, 7, 8, 9, 12, 30, 120))))
        rows.append((len(rows) * 3 + 1, text.upper() if kind > 0.97 else text))
    rnd.shuffle(rows)
    return rows


def family(seed, n):
    """Copies of one text, each with its own changes: about 0.8 like it, and 0.6 to 0.75 like each other."""
    rnd = random.Random(seed)
    base = [f"b{i}" for i in range(130)]
    rows = []
    for i in range(n):
        words = list(base)
        for k in rnd.sample(range(130), rnd.choice((2, 3, 3, 4))):
            words[k] = f"own{i}x{k}"
        rows.append((i + 10_000, " ".join(words)))
    return rows


@pytest.mark.parametrize(("name", "value"), [("BLOCK", 8), ("SHORT", 40), ("WIDTH", 16), ("STRIP", 3), ("HOT_SHARE", 3)])
def test_a_boilerplate_family_equals_all_pairs(spark, monkeypatch, name, value):
    monkeypatch.setattr(nd, "BLOCK", 16)
    monkeypatch.setattr(nd, name, value)
    rows = family(3, 90) + [(i, f"b{i} copy of many rows and nothing else") for i in (1, 2)] + [(500 + i, "one hot text held by many rows of all") for i in range(60)]
    got = sorted(map(tuple, nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows) and len({g[2] for g in got if g[0] >= 10_000}) > 5


def test_a_forest_that_blurred_hashes_made_is_checked(spark, monkeypatch):
    """Every pair of a block passes as certain here: the full sets still decide, and no link is lost."""
    rows = family(4, 40)

    def lax(self, left, right):
        import numpy as np

        x, y = (v.ravel() for v in np.meshgrid(np.arange(left.start, left.stop), np.arange(right.start, right.stop), indexing="ij"))
        ok = (self.component[x] != self.component[y]) & ((left.start != right.start) | (x < y))
        return x[ok], y[ok], np.ones(int(ok.sum()), bool)

    lax.__module__ = "__main__"
    monkeypatch.setattr(nd.Block, "passing", lax)
    got = sorted(map(tuple, nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows)


def test_equals_all_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    rows = corpus(2, 400)
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", nd.F.lit(1)).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, q.op6_near_dup(spark, str(tmp_path)).collect())) == brute(rows)


def test_chains_and_shapes(spark):
    words = [f"x{i}" for i in range(60)]
    rows = [(k, " ".join(words[k : k + 40])) for k in range(12)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "one two"), (104, "ONE  two"), (105, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, nd.near_duplicates(df).collect()))
    assert got == brute(rows) and {g[2] for g in got if g[0] < 12} == {0}
    assert nd.near_duplicates(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, "lone words here"), (8, "q"), (8, "q")], "doc_id long, text string")
    assert sorted((r.component_id or -1, r.kept) for r in nd.near_duplicates(nulls).collect()) == [(-1, True), (7, False), (7, True), (8, True), (8, True)]
    assert nd.keep(nulls).count() == 3


def test_registers_estimate_jaccard():
    import numpy as np

    rng = np.random.default_rng(0)
    for j in (0.2, 0.75, 0.95):
        n = 5000
        shared = rng.integers(0, 2**63, int(2 * n * j / (1 + j)), dtype=np.int64).astype(np.uint64) * np.uint64(2)
        own = [rng.integers(0, 2**63, n - len(shared), dtype=np.int64).astype(np.uint64) * np.uint64(2) for _ in range(2)]
        a, b = (nd.registers(np.unique(np.concatenate((shared, x)))) for x in own)
        assert abs(((a == b) & (a > 0)).mean() - j) < 0.12
        assert bool(nd.likely(a[None], b[None], np.array([n]), np.array([n]))[0]) == (j > 0.5)


def test_registers_of_small_sets_estimate_jaccard_in_a_common_class():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, m in ((3, 4), (15, 18), (40, 40), (60, 75), (250, 300)):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate((x, rng.integers(0, 2**63, m - n, dtype=np.int64).astype(np.uint64))))
        size = int(nd.size_class(n))
        assert size in (nd.size_class(m), nd.size_class(-(-3 * m // 4)))
        a, b = nd.registers(x, size), nd.registers(y, size)
        assert (a > 0).mean() > 0.95 and abs(((a == b) & (a > 0)).mean() - n / m) < 0.15


def test_rows_without_an_id_and_rows_that_share_one_go_by_their_own_texts(spark):
    old, other, third = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(7, old), (9, other), (None, old + " more"), (None, "lone words here"), (None, other), (None, third), (20, old), (20, "words of one text alone"), (20, other + " more"), (None, None), (30, third)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(7, old), (9, other), (None, "lone words here"), (20, "words of one text alone"), (None, None), (30, third)]
    order = lambda r: (r[0] or -1, r[1] or "")
    assert sorted(map(tuple, nd.keep(df).collect()), key=order) == sorted(kept, key=order)
    want = [(7, 7, True), (9, 9, True), (-1, 7, False), (-1, -1, True), (-1, 9, False), (-1, 30, False), (20, 7, False), (20, 20, True), (20, 9, False), (-1, -1, True), (30, 30, True)]
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in nd.near_duplicates(df).collect()) == sorted(want)


def test_a_block_of_large_like_sets_hands_on_a_forest():
    """Sets of more than SHORT hashes were handed on in all pairs, with the square of a block's members."""
    import numpy as np

    rng = np.random.default_rng(5)
    m, base = 40, rng.integers(0, 2**63, 900, dtype=np.int64)
    own = [np.unique(np.append(base, rng.integers(0, 2**63, 30, dtype=np.int64)).astype(np.uint64)) for _ in range(m - 1)]
    own.append(np.unique(rng.integers(0, 2**63, 900, dtype=np.int64).astype(np.uint64)))
    block = nd.Block(np.arange(m), np.arange(m), np.array([len(s) for s in own]), [s.tobytes() for s in own])
    a, b = block.links(slice(0, m), slice(0, m))
    assert len(a) == m - 2 and {*a.tolist(), *b.tolist()} == set(range(m - 1))


def test_full_sets_go_once_to_buckets_that_hang_together(spark, monkeypatch):
    """A node's full set was dealt once for each of its buckets."""
    rows = [(key, node, 1) for key in range(100, 130) for node in (1, 2, 3)] + [(200, 3, 3), (200, 4, 3), (300, 8, 8), (300, 9, 8)]
    inside = spark.createDataFrame(rows, "key long, node long, first long")
    found = spark.createDataFrame([(8, 8), (9, 8)], "node long, component long")
    nodes = spark.createDataFrame([(i, 10) for i in range(1, 10)], "node long, n int")
    full = spark.createDataFrame([(i, bytes(80)) for i in range(1, 10)], "node long, full binary")
    dealt = nd._dealt(inside, found, full, nodes).collect()
    assert sorted((r.key, r.node, r.i, r.j) for r in dealt) == [(1, n, 0, 0) for n in (1, 2, 3, 4)]
    # a group that no block holds stays in its buckets
    monkeypatch.setattr(nd, "BLOCK", 3)
    dealt = nd._dealt(inside, found, full, nodes).collect()
    assert sorted((r.key, r.node) for r in dealt) == sorted((k, n) for k, n, _ in rows if k < 300)
