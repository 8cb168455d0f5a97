"""Planted passages, re-parameterised questions, contradictions, and a brute-force count of windows."""

import random

from spanforge.llm import decontaminate as dc

Q = "A train leaves the station with Alice at 60 km per hour while Bob waits for Alice near the old bridge for 15 minutes. How far does Alice travel before Bob meets Alice?"
SWAPPED = Q.replace("Alice", "Carol").replace("Bob", "Dave").replace("60", "85").replace("15", "40").replace("km", "miles")
CONTRADICTED = Q.replace("with Alice", "with Carol").replace("for Alice", "for Erin").replace("does Alice", "does Mary").replace("meets Alice", "meets Anna")


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def words(rnd, n):
    return " ".join(rnd.choices(["river", "stone", "of", "the", "light", "walks", "over", "small", "green", "hills", "and", "winter"], k=n))


def found(d, b):
    return {(r.doc_id, r.item_id): r.kind for r in dc.contaminated(d, b).collect()}


def test_planted_cases(spark):
    rnd = random.Random(4)
    docs = [(1, f"{words(rnd, 30)}. {Q} {words(rnd, 20)}"), (2, f"{words(rnd, 30)} {SWAPPED}"), (3, CONTRADICTED), (4, words(rnd, 300)), (5, None), (6, ""), (7, " ".join(Q.split()[:12])), (8, "In 60 km. " * 50)]
    d, b = frames(spark, docs, [(10, Q), (11, "too few words"), (12, None), (13, "seven plain words are in this one")])
    assert found(d, b) == {(1, 10): "exact", (2, 10): "reparameterised"}
    assert found(d.limit(0), b) == {} and found(d, b.limit(0)) == {}


def test_coverage_against_brute_force(spark):
    rnd = random.Random(9)
    items = [(i, words(rnd, rnd.randint(6, 40))) for i in range(12)]
    docs = []
    for i in range(80):
        parts = [words(rnd, rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 2)):
            w = rnd.choice(items)[1].split()
            cut = rnd.randint(0, len(w) // 2)
            parts += [" ".join(w[cut:] if rnd.random() < 0.5 else w), words(rnd, rnd.randint(0, 20))]
        docs.append((i, " ".join(parts)))
    docs += [(0, docs[0][1]), (None, docs[1][1])]
    want = set()
    by_key = {}
    for k, t in docs:
        by_key.setdefault(k, []).append(t.split())
    for k, texts in by_key.items():
        for i, t in items:
            w = t.split()
            n = min(len(w), dc.WIDTH)
            covered = set()
            for d in texts:
                grams = {tuple(d[p : p + n]) for p in range(len(d) - n + 1)}
                for p in range(len(w) - n + 1):
                    if tuple(w[p : p + n]) in grams:
                        covered |= set(range(p, p + n))
            if len(covered) >= dc.COVERED * len(w):
                want.add((k, i))
    d, b = frames(spark, docs, items)
    assert set(found(d.withColumn("at", dc.F.lit(1)).withColumn("h", dc.F.lit(1)), b)) == want and want


def test_the_shuffled_way_is_the_same(spark, monkeypatch):
    d, b = frames(spark, [(1, "x " * 30 + SWAPPED), (2, "y")], [(10, Q)])
    a = sorted(map(tuple, dc.contaminated(d, b).collect()))
    monkeypatch.setattr(dc, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, dc.contaminated(d, b).collect())) == a and len(a) == 1


def test_items_of_numbers_and_short_items(spark, monkeypatch):
    total = "Find the sum of 12, 45, 78, 23, 56, 89, 34, 67, 90 and 11."
    torn = "Find the sum of 12, 45, 78, 23 or 1, 2, 3, 4, 5 and 6."
    items = [(20, total), (21, "What is 345 + 678?"), (22, "12 45 78 23 56 89"), (23, "..."), (24, "42")]
    docs = [(1, f"so it goes. {total} the end"), (3, torn), (4, "well, What is 345 + 678? said"), (5, "What is 346 + 678?"), (6, "7 8 9 10 11 12 13 14 15 16 17 18"), (7, "it is 42 then"), (8, "it is 43 then")]
    d, b = frames(spark, docs, items)
    want = {(1, 20): "exact", (4, 21): "exact", (1, 22): "exact", (7, 24): "exact"}
    assert found(d, b) == want
    monkeypatch.setattr(dc, "BROADCAST_ROWS", -1)
    assert found(d, b) == want


def test_changed_numbers_do_not_undo_a_match_of_words(spark):
    item = " ".join(f"word{chr(97 + i)}" for i in range(20)) + " 1 2 3 4 1 2"
    d, b = frames(spark, [(1, item[:-11] + "5 6 7 8 9 9"), (2, item)], [(1, item)])
    assert found(d, b) == {(1, 1): "reparameterised", (2, 1): "exact"}


def test_kind_of_a_copy_with_one_other_value_and_an_insertion(spark):
    item = " ".join(f"{w} {n}" for w, n in zip("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split(), "apples pears plums figs dates nuts beans peas limes kiwis grapes leeks".split())) + " when 12 of them were sold on the market of the old town by the young farmer"
    half = item.split()
    changed = " ".join(half[:10] + ["quite"] + half[10:]).replace("12", "99")
    twice = f"{item} and again {item.replace('12', '7')}"
    d, b = frames(spark, [(1, changed), (2, item), (3, twice), (4, item.replace("12", "99"))], [(1, item)])
    assert found(d, b) == {(1, 1): "reparameterised", (2, 1): "exact", (3, 1): "exact", (4, 1): "reparameterised"}


def test_places_that_contradict_each_other_do_not_add_up(spark):
    w = [f"w{chr(97 + i)}{chr(97 + i)}" for i in range(24)]
    item = " ".join([*w[:6], "12", *w[6:12], "12", *w[12:18], "12", *w[18:]])
    at = item.split()
    first, second = " ".join(at[:13]).replace("12", "40"), " ".join(at[14:]).replace("12", "50")
    agreeing = " ".join(at[14:]).replace("12", "40")
    d, b = frames(spark, [(1, f"{first} filler words stand here {second}"), (2, f"{first} filler words stand here {agreeing}")], [(1, item)])
    rows = {r.doc_id: (r.coverage, r.kind) for r in dc.contaminated(d, b, covered=0.1).collect()}
    assert rows[2][0] > rows[1][0] and rows[2][1] == rows[1][1] == "reparameterised"


def test_a_very_long_text(spark):
    rnd = random.Random(1)
    d, b = frames(spark, [(1, words(rnd, 60_000) + " " + Q + " " + words(rnd, 60_000)), (2, words(rnd, 100_000))], [(1, Q)])
    assert found(d, b) == {(1, 1): "exact"}
