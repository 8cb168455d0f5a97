"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is a built-in expression on one row: no shuffle, no Python. Offsets are code points
(Spark's ``length``), end exclusive. Quantifiers that Java would run recursively are possessive,
which cannot change a match here (nothing that follows could use what they give back) and keeps
stack and time linear in the text. An IBAN may run on into capitals and digits after it, so each of
its heads is tried by itself, with each end that it can have.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text as T

from .common import text_of

MARK = "\u0001"
#: Takes the place of MARK in a text: one code point as well, and in no pattern's classes.
STAND_IN = "\u0003"
SPAN = "struct<kind:string,start:int,end:int,score:double>"
NONE = f"cast(array() as array<{SPAN}>)"
#: Code points of context on either side of a span.
CONTEXT = 48
#: Code points of the pages that contexts are cut from.
PAGE = 1024


@dataclass(frozen=True)
class Kind:
    """``probe``: cheap test that a text may have a match; ``check``: of a match's text;
    ``base``: the score of a confirmed span, to which context words add ``boost``."""

    name: str
    pattern: str
    probe: str
    check: object
    base: float
    boost: float
    words: str


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """True if a string of digits has a Luhn check digit."""
    at = F.transform(F.split(F.reverse(d), ""), lambda x, i: F.struct(x.try_cast("int").alias("x"), (i % 2).alias("odd")))
    part = F.transform(F.filter(at, lambda s: s["x"].isNotNull()), lambda s: F.when(s["odd"] == 0, s["x"]).otherwise((s["x"] * 2) % 10 + F.floor(s["x"] * 2 / 10).cast("int")))
    return F.aggregate(part, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(m: Column) -> Column:
    """True if an IBAN's rearranged number leaves 1 when divided by 97."""
    s = F.regexp_replace(m, " ", "")
    turned = F.split(F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4))), "")
    rest = F.aggregate(
        F.filter(turned, lambda c: c != ""),
        F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


#: Lengths of the IBANs of registered countries.
IBAN_LENGTH = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}


def iban(run: Column) -> Column:
    """The IBAN that a run of words begins with; null if there is none.

    It ends with a word and has its country's length; of countries not registered, the longest
    that passes the check is taken.
    """
    words = F.split(run, " ")
    of = F.create_map(*(F.lit(x) for kv in IBAN_LENGTH.items() for x in kv))[F.substr(run, F.lit(1), F.lit(2))]
    ends = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, 1, i), " "))

    def fits(m: Column) -> Column:
        n = F.length(F.regexp_replace(m, " ", ""))
        return F.coalesce(n == of, n.between(15, 34)) & ~m.rlike("[a-z]") & mod97(m)

    return F.get(F.reverse(F.filter(ends, fits)), 0)


def iban_hits(text: Column) -> Column:
    """Leftmost non-overlapping IBANs as ``(start, end, m)``."""
    # the sign after the longest run goes with it, so that a word cut off by the bound or by a small letter never fits
    run = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?+"
    head = rf"(?<![A-Za-z0-9])(?=({run}))"
    parts = F.split(F.regexp_replace(text, head, MARK), MARK, -1)
    lengths = F.transform(parts, lambda p: F.length(p))
    runs = F.transform(F.regexp_extract_all(text, F.lit(head), F.lit(1)), lambda r, i: F.struct(i.alias("i"), iban(r).alias("m")))

    # a run begins where the part before its mark ends
    starts = T.bound(lengths, lambda n: F.zip_with(n, T.running(n), lambda x, at: x + at))
    found = T.bound(starts, lambda at: F.transform(runs, lambda x: F.struct(F.get(at, x["i"]).alias("start"), (F.get(at, x["i"]) + F.length(x["m"])).alias("end"), x["m"].alias("m"))))
    return disjoint(F.filter(found, lambda h: h["m"].isNotNull()))


def disjoint(hits: Column) -> Column:
    """Of ``(start, end, m)`` in order of start, each that begins no sooner than the last one taken ends.

    Taken in arrays of the square root of the hits, for a growing array is copied at each of them.
    """
    kept = "cast(array() as array<struct<start:int,end:int,m:string>>)"

    def one(a: Column, h: Column) -> Column:
        return F.when(h["start"] >= a["last"], F.struct(h["end"].alias("last"), F.array_append(a["out"], h).alias("out"))).otherwise(a)

    def block(a: Column, b: Column) -> Column:
        inner = F.aggregate(b, F.struct(a["last"].alias("last"), F.expr(kept).alias("out")), one)
        return T.bound(inner, lambda x: F.struct(x["last"].alias("last"), F.array_append(a["out"], x["out"]).alias("out")))

    def blocks(x: Column) -> Column:
        width = F.greatest(F.lit(1), F.floor(F.sqrt(F.size(x).cast("double"))).cast("int"))
        cut = F.transform(F.sequence(F.lit(0), F.size(x) - 1, width), lambda i: F.slice(x, i + 1, width))
        zero = F.struct(F.lit(0).alias("last"), F.expr(f"cast(array() as array<{kept[16:-1]}>)").alias("out"))
        return F.flatten(F.aggregate(cut, zero, block, lambda a: a["out"]))

    return T.bound(hits, lambda x: F.when(F.size(x) > 0, blocks(x)).otherwise(F.expr(kept)))


def _card(m: Column) -> Column:
    d = digits(m)
    return F.length(d).between(16, 19) & luhn(d)


def _ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.substr(F.regexp_replace(p, "^0+", ""), F.lit(1), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))


#: Base kinds, in the order of the digest.
BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.8, 0.15, "e-?mail|contact|reach|write|mailto"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", _ip, 0.6, 0.3, r"\bip\b|address|host|server|login|logged"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][0-9\x20-]{14,}", _card, 0.75, 0.2, "card|visa|master|credit|debit|payment|account"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda m: F.length(digits(m)).between(8, 15), 0.7, 0.25, r"phone|\btel|mobile|call|fax|whatsapp"),
)
#: Kinds of the method's own. A span is kept from ``threshold`` on, so that a bare 9-digit group needs its context word.
MORE = (
    Kind("iban", "", r"[A-Z]{2}[0-9]{2}", None, 0.9, 0.1, "iban|bank|account|transfer"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda m: F.lit(True), 0.3, 0.5, "ssn|social security|tax id"),
    Kind("pan", r"(?<![0-9+.])(?:3[47][0-9]{13}|3[068][0-9]{12}|4[0-9]{12})(?![0-9.])", "[0-9]{13}", lambda m: luhn(m), 0.4, 0.4, "card|visa|amex|american express|diners|credit|debit"),
)


def spans_of(text: Column, kind: Kind, threshold: float) -> Column:
    """Array of span structs: leftmost non-overlapping matches of a kind that pass its check.

    The matches are set between marks, the marked text is split, and offsets follow from the
    lengths of the parts; odd parts are matches. IBANs come from ``iban_hits``. Time grows with the
    text and, but for appending to short arrays, with the hits.
    """
    parts = T.spans_of_parts(F.split(F.regexp_replace(text, kind.pattern, f"{MARK}$0{MARK}"), MARK, -1))
    odd = F.filter(F.transform(parts, lambda p, i: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.when(i % 2 == 1, p["part"]).alias("m"))), lambda h: h["m"].isNotNull())
    hits = F.filter(odd, lambda h: kind.check(h["m"])) if kind.pattern else iban_hits(text)

    def between(pages: Column, low: Column, n: Column) -> Column:
        """``n`` code points from ``low``: at most CONTEXT, so of one page and the next."""
        first = F.floor(low / PAGE).cast("int")
        return F.substr(F.concat(F.get(pages, first), F.coalesce(F.get(pages, first + 1), F.lit(""))), low % PAGE + 1, n)

    def scored(pages: Column, h: Column) -> Column:
        low = F.greatest(h["start"] - CONTEXT, F.lit(0))
        near = F.concat_ws(" ", between(pages, low, h["start"] - low), between(pages, h["end"], F.lit(CONTEXT)))
        score = F.lit(kind.base) + F.when(near.rlike(f"(?i){kind.words}"), F.lit(kind.boost)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), h["start"].alias("start"), h["end"].alias("end"), F.round(score, 3).alias("score"))

    def all_scored(found: Column) -> Column:
        # a place in a long text is reached by counting code points from its beginning; in a page, from the page's
        pages = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))
        none = F.expr(NONE)
        return F.when(F.size(found) > 0, T.bound(pages, lambda p: F.transform(found, lambda h: scored(p, h)))).otherwise(none)

    out = T.bound(hits, all_scored)
    if threshold > kind.base:
        out = F.filter(out, lambda s: s["score"] >= threshold)
    probe = F.contains(text, F.lit(kind.probe)) if kind.probe == "@" else text.rlike(kind.probe)
    return F.when(probe, out.cast(f"array<{SPAN}>")).otherwise(F.expr(NONE))


def personal_data(docs: DataFrame, text: str = "text", threshold: float = 0.55) -> DataFrame:
    """``docs`` with ``base`` and ``more``: arrays of ``(kind, start, end, score)``.

    Base kinds keep every confirmed span whatever its score; kinds of the method's own are kept
    from ``threshold`` on. Null and empty texts have no spans; repeated rows give repeated rows;
    an empty table gives an empty table; input columns called ``base`` or ``more`` are replaced.
    """
    t = F.translate(text_of(text), MARK, STAND_IN)
    base = F.concat(*(spans_of(t, k, 0.0) for k in BASE))
    more = F.concat(*(spans_of(t, k, threshold) for k in MORE))
    return docs.withColumns({"base": base, "more": more})
