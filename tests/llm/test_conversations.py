"""Conversation repair against an exhaustive search, over many pieces, and on odd rows."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from spanforge.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def search(rows):
    """Cheapest (cost, audit, told) by Dijkstra over whole prefixes; ``rows``: (role, text, must_go, cut)."""
    heap, seen = [(0, "", 0, ())], set()
    while heap:
        cost, audit, at, told = heapq.heappop(heap)
        shape = "".join(r[:1] for r, _ in told)
        if at == len(rows) and GRAMMAR.fullmatch(shape):
            return cost, audit, told
        key = (at, shape[-1:], not shape)
        if (key, cost, audit) in seen:
            continue
        seen.add((key, cost, audit))
        # a prefix of the grammar: nothing, or a system row, or users and assistants in turn
        fits = lambda t: re.fullmatch(r"s?(ua)*u?", "".join(r[:1] for r, _ in t))
        for role in ("user", "assistant"):
            if fits(new := (*told, (role, ""))) and cost <= 3 * len(rows) + 11:
                heapq.heappush(heap, (cost + 5, audit + "I", at, new))
        if at < len(rows):
            role, text, go, cut = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, told))
            for made in () if go else {role, "user", "assistant"}:
                if fits(new := (*told, (made, text))):
                    for edit, price in (("K", 0), ("R", 1)):
                        if (edit == "K") <= (made == role) and (edit == "R") <= (made in ("user", "assistant")):
                            heapq.heappush(heap, (cost + price + 5 * cut, audit + edit, at + 1, new))
    raise AssertionError


def plain(rows, find=search):
    """Rows (conv, turn, role, text) before damage to the contract's columns."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role = "user" if fate == 4 else role
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            after += [(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
        digest = lambda r: hashlib.md5((hashlib.md5(r[1].encode()).hexdigest() + r[2]).encode()).hexdigest()
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        seen, marked, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in after:
            rest = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for t, _, _ in after if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        cost, audit, told = find(marked)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in told).encode()).hexdigest()
        out[conv] = (gaps, *count.values(), illegal, cost, audit, digest)
    return out


def got(spark, rows, schema=SCHEMA):
    found = C.repair(C.damaged(spark.createDataFrame(rows, schema))).collect()
    assert len(found) == len({r["conv_id"] for r in found})
    return {r["conv_id"]: tuple(r[c] for c in (*C.RESULT[:-1], "cost", "audit", "repaired_sha256")) for r in found}


def test_short_conversations_equal_an_exhaustive_search(spark):
    rng = random.Random(3)
    texts = ["Yes.", "No!", "broken off", "", " \t", "Why?", "so"]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(["system", "user", "assistant", "tool", None]), rng.choice([*texts, None]))
            for c in range(150) for _ in range(rng.randint(1, 5))]
    assert got(spark, rows) == plain(rows)


def forward(rows):
    """A plain forward pass that keeps whole sequences, for long conversations."""
    layer = {"": (0, "", ())}

    def better(layer, shape, new):
        state = shape if shape in ("", "s") else shape[-1]
        if state not in layer or new[:2] < layer[state][:2]:
            layer[state] = new

    def closed(layer):
        for _ in range(3):
            for s, (cost, audit, told) in list(layer.items()):
                made = "assistant" if s == "u" else "user"
                better(layer, made[0], (cost + 5, audit + "I", (told, (made, ""))))
        return layer

    layer = closed(layer)
    for role, text, go, cut in rows:
        new = {}
        for s, (cost, audit, told) in layer.items():
            better(new, s, (cost + 2, audit + "D", told))
            if not go:
                made = "assistant" if s == "u" else "user"
                better(new, made[0], (cost + 1 + 5 * cut, audit + "R", (told, (made, text))))
                if (s, role[:1]) in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                    better(new, role[:1], (cost + 5 * cut, audit + "K", (told, (role, text))))
        layer = closed(new)
    cost, audit, told = min(v for k, v in layer.items() if k in ("", "a"))
    flat = []
    while told:
        told, last = told
        flat.append(last)
    return cost, audit, flat[::-1]


@pytest.mark.parametrize("alike", [False, True])
def test_one_conversation_over_many_tasks(spark, alike):
    rng = random.Random(5)
    text = (lambda i: "Same.") if alike else (lambda i: rng.choice([f"Number {i}.", f"cut {i}", "Again."]))
    rows = [(7, i if i % 3 else None, rng.choice(["user", "assistant"]), text(i)) for i in range(3000)] + [(c, 0, "user", "Hi.") for c in range(5)]
    assert got(spark, rows) == plain(rows, forward)


def test_pieces_chain_to_the_whole():
    rng = random.Random(1)
    rows = [(rng.choice("suat"), False, rng.random() < 0.2, rng.random() < 0.2, rng.randint(1, 3)) for _ in range(700)]

    def piece(part, layers):
        p = C.Piece(layers)
        for i, row in part:
            p.add(i, *row)
        return {**{c: getattr(p, c) for c in C.COUNTS}, "first": p.first, "last": p.last, "low": p.low, "high": p.high,
                "layers": [[None if b is None else {"cost": b[0], "audit": b[1]} for b in layer] for layer in p.transitions()]}

    every = list(enumerate(rows))
    whole = C.joined([piece(every, C.opened())])
    for cuts in ([1], [350], [0, 129, 129, 699], list(range(1, 700, 41))):
        edges = [0, *cuts, 700]
        assert C.joined([piece(every[a:z], C.identity()) for a, z in zip(edges, edges[1:])]) == whole


def test_defined_results(spark):
    assert got(spark, []) == {}
    dropped = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert got(spark, [(dropped, 0, "user", "Gone.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", empty)}
    long = [(1, 0, "user", "long " * 200_000 + "."), (1, 1, "assistant", "Ok."), (None, None, None, None), (None, None, "user", "a?")]
    long += [(3, 0, "user", "Twice."), (3, 0, "user", "Twice."), (3, 0, "assistant", "Tie."), (4, -(2**63), "user", "a."), (4, 2**63 - 1, "assistant", "b.")]
    wanted = plain(long)
    if 4 in wanted:
        wanted[4] = (min(wanted[4][0], 2**63 - 1), *wanted[4][1:])
    assert got(spark, long) == wanted
    wide = spark.createDataFrame([(1, 0, "user", "a.", 1, "x", 2)], SCHEMA + ", digest int, `result` string, `x.y` int")
    assert C.repair(C.damaged(wide)).count() == 1
