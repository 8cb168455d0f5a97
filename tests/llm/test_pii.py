"""Base spans against Python's re, method spans on planted cases."""

import hashlib
import random
import re
import time

import pytest

from spanforge.llm import pii
from spanforge.llm import queries as q

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x // 10 + x % 10
    return s % 10 == 0


def brute(text):
    out = []
    d = lambda m: re.sub("[^0-9]", "", m)
    for kind, pattern, good in (
        ("email", EMAIL, lambda m: True),
        ("ip", IP, lambda m: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.split("."))),
        ("card", CARD, lambda m: 16 <= len(d(m)) <= 19 and luhn(d(m))),
        ("phone", PHONE, lambda m: 8 <= len(d(m)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text or "") if good(m[0])]
    return out


CASES = [
    None, "", "plain words", "é€😀 a.b+c@mail.example.com, x@y, a@b.com_c@d.com a@b@c.de", "\u0001a@b.co\u0001 \u0002 c@d.co",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004 1..2.3.4 00000000001.1.1.1 99999999999999999999.1.1.1",
    "4207051279108084 4207-0512-7910-8084 4207 0512 7910 8085 4207  0512", "4" * 40, "+1 (375) 555-4393 +1 +12 ++1 (5)) 555 +49 30 1234567890123456",
    "+1 (375) 555-4393 card 4207051279108084 4207051279108084", "a@b.com" * 50, "x" * 20000 + "@a.b", "1 " * 8000, "9" * 10000 + ".1.1.1", ".".join(["a@b"] + ["c"] * 8000),
]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_base_spans_equal_brute_force(spark):
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in pii.personal_data(rows(spark, CASES)).collect()}
    for i, t in enumerate(CASES):
        assert got[i] == brute(t), (i, t and t[:80])


def test_digest_over_a_table(spark, tmp_path):
    rows(spark, CASES).withColumn("score", pii.F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    for r in q.op10_pii(spark, str(tmp_path)).collect():
        want = brute(CASES[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.spans.startswith(joined)
        assert r.n_email == sum(k == "email" for k, *_ in want) and r.n_phone == sum(k == "phone" for k, *_ in want)


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("IBAN GB82 WEST 1234 5698 7654 32 ok", ["iban"]),
        ("GB83WEST12345698765432", []),
        ("ssn 123-45-6789", ["ssn"]),
        ("part 123-45-6789", []),
        ("amex card 378282246310005", ["pan"]),
        ("order 378282246310005", []),
    ],
)
def test_method_spans(spark, text, kinds):
    assert [s.kind for s in pii.personal_data(rows(spark, [text])).first().more] == kinds


def test_context_raises_the_score_and_shapes_hold(spark):
    a, b = (pii.personal_data(rows(spark, [t])).first().base[0].score for t in ("write to a@b.com", "a@b.com"))
    assert a > b
    df = spark.createDataFrame([(1, "a@b.com", 5), (1, "a@b.com", 5)], "doc_id long, text string, base int")
    assert [len(r.base) for r in pii.personal_data(df).collect()] == [1, 1]
    assert pii.personal_data(rows(spark, [])).count() == 0


def test_ibans_before_capitals_and_digits(spark):
    a, b, c = "GB82WEST12345698765432", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    cases = [(f"é {a} Please", [a]), (f"{b} 2024", [b]), (f"{c} BIC NWBKGB2L", [c]), (f"{a} {b}", [a, b]), (f"REF AT61 {c} {b}", [c, b]), (f"{a}X", []), (f"{a} {a[:-1]}", [a]), (c, [c]), (f"{a}please", [])]
    got = [[t[s.start : s.end] for s in r.more] for t, r in zip((t for t, _ in cases), pii.personal_data(rows(spark, [t for t, _ in cases])).orderBy("doc_id").collect(), strict=True)]
    assert got == [w for _, w in cases]


@pytest.mark.parametrize("text, n", [(" ".join(f"u{i}@ex.com" for i in range(100_000)), 100_000), ("1." * 150_000, 37_500), ("10.0.0.1 " * 100_000, 100_000)])
def test_many_hits_in_one_text(spark, text, n):
    began = time.perf_counter()
    assert pii.personal_data(rows(spark, [text])).select(pii.F.size("base")).first()[0] == n
    assert time.perf_counter() - began < 40


def test_context_of_adjacent_and_distant_hits_equals_slices(spark):
    """Scores go by CONTEXT code points on either side, wherever pages of a text end."""
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a@b.co ", "mail ", "é" * rng.randint(1, 60), "call +1 234 567 8901 ", "\U0001f600 "]) for _ in range(rng.randint(1, 300))) for _ in range(20)]
    for t, r in zip(texts, pii.personal_data(rows(spark, texts)).orderBy("doc_id").collect(), strict=True):
        for s in r.base:
            kind = next(k for k in pii.BASE if k.name == s.kind)
            near = t[max(0, s.start - pii.CONTEXT) : s.start] + " " + t[s.end : s.end + pii.CONTEXT]
            assert s.score == round(kind.base + (kind.boost if re.search(kind.words, near, re.I) else 0), 3)
