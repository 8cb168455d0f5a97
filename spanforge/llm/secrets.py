"""Secrets: fixed patterns, and a randomness test battery under false-discovery control.

A candidate is a token of 16 signs or more, with a letter and a digit in it, of an encoding's
alphabet; its encoding is the smallest alphabet that holds it. The battery asks of it how evenly
the alphabet is used (chi-squared), how often letter case and digits alternate (runs), and how far
neighbours depend on each other (serial correlation). Each statistic has two p-values. Against
"written text of this corpus" the null distribution comes from the letter pairs of all documents,
restricted to the encoding; against "uniform over the alphabet" it is known. Fisher's rule
combines the three. Benjamini-Hochberg over all candidates of the corpus, with weights by length,
bounds the share of false discoveries among tokens that the battery tells from text. Of these
one is dropped that the battery also tells from uniform symbols, or that the likelihood ratio of
the letter-pair model, a further test, does not tell from text.

Two passes over the texts: ``fit`` gathers pair counts and candidate tokens (no texts, no ids),
``find`` marks spans row by row. Nothing is joined, so a hot source or a group of copies weighs
no more than its rows.
"""

import math
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

#: Group 2 is the value. Letters of the key in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ORDER = {"assign": 0, "access": 1, "hex": 2, "random": 3}

SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/-_="
OTHER = len(SYMBOLS)
CLASSES = OTHER + 1
TABLE = np.full(256, OTHER, np.uint8)
for _i, _c in enumerate(SYMBOLS):
    TABLE[ord(_c)] = _i
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[+/_=-]*[A-Za-z0-9])[A-Za-z0-9+/_-]{16,}={0,2}")
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
CODES = []
for _name, _alphabet in ENCODINGS:
    _t = np.full(256, 255, np.uint8)
    for _i, _c in enumerate(_alphabet):
        _t[ord(_c)] = _i
    CODES.append((_name, len(_alphabet), _t))
#: Lower case, upper case, digits and signs: what a run is made of.
KIND = np.array([0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in SYMBOLS] + [4])
#: Letters seen before a symbol count as so many more, spread as in all text; rows of rare symbols lean on it.
BACK_OFF = 500
#: Finest step of -log10(p) told apart by the false-discovery cut, and the largest value.
STEP, TOP = 0.02, 200.0
#: Level of each further test.
ALPHA = 1e-4


@dataclass(frozen=True)
class Null:
    """Written text in the symbols of one encoding: chance that two symbols are equal, and three; that the kind
    of symbol changes; lag-1 correlation of the codes."""

    two: float
    three: float
    change: float
    serial: float


@dataclass(frozen=True)
class Model:
    """log10 of the pair model, text in each encoding, the mean length weight, and the -log10(p / weight) of a discovery."""

    pairs: np.ndarray
    nulls: tuple[Null, ...]
    mean_weight: float
    cut: float


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, order, end)`` of the fixed patterns' matches, sorted."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi2_tail(x: float, df: float) -> float:
    """Upper tail by Wilson and Hilferty."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(codes: np.ndarray, m: int) -> float:
    """p-value of "uniform over m symbols" from three tests."""
    n = len(codes)
    counts = np.bincount(codes, minlength=m)
    stat = m / n * float((counts.astype(np.float64) ** 2).sum()) - n
    shrink = 1 - 1 / n
    p1 = _chi2_tail(max(stat, 1e-9) / shrink, (m - 1) / shrink)
    high = codes >= m // 2
    a = int(high.sum())
    b = n - a
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 2 * a * b / n + 1
        var = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        p2 = _normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p2 = 2.0 ** (1 - n)
    x = codes - codes.mean()
    v = float((x * x).sum())
    p3 = _normal_tail(float((x[1:] * x[:-1]).sum()) / v * math.sqrt(n)) if v > 0 else 0.0
    fisher = -2 * sum(math.log(max(p, 1e-300)) for p in (p1, p2, p3))
    half = fisher / 2
    return math.exp(-half) * (1 + half + half * half / 2)


def nulls(counts: np.ndarray) -> tuple[Null, ...]:
    """Text in each encoding's symbols, from counts of letter pairs."""
    out = []
    for _, alphabet in ENCODINGS:
        at = np.array([SYMBOLS.index(c) for c in alphabet])
        n = counts[np.ix_(at, at)].astype(float)
        total = n.sum()
        q = (n.sum(0) + n.sum(1) + 1) / (2 * total + len(at))
        change = float((n * (KIND[at][:, None] != KIND[at][None, :])).sum())
        x = np.arange(len(at)) - q @ np.arange(len(at))
        serial = float(x @ n @ x) / max(1.0, total) / float(q @ (x * x))
        out.append(Null(float(q @ q), float((q**3).sum()), (change + 1) / (total + 2), min(max(serial, -0.95), 0.95)))
    return tuple(out)


def _binomial_tail(n: int, k: int, p: float) -> float:
    """Chance of ``k`` or more of ``n``."""
    if k <= 0:
        return 1.0
    if k > n:
        return 0.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in log)) if top > -700 else 1e-300


def against_text(token: np.ndarray, codes: np.ndarray, null: Null) -> float:
    """p-value of "written text" from the three tests. ``token``: places in SYMBOLS.

    Few equal symbols, many changes of kind (beyond the two that the digit of any candidate makes)
    and a correlation unlike the text's speak against it.
    """
    n = len(codes)
    counts = np.bincount(codes)
    equal = float((counts * (counts - 1)).sum()) / 2
    pairs = n * (n - 1) / 2
    var = pairs * (null.two - null.two**2) + n * (n - 1) * (n - 2) * max(0.0, null.three - null.two**2)
    z = (equal - pairs * null.two) / math.sqrt(max(var, 1e-12))
    p1 = 0.5 * math.erfc(-z / math.sqrt(2))
    changes = int((KIND[token[1:]] != KIND[token[:-1]]).sum())
    p2 = _binomial_tail(n - 3, changes - 2, null.change)
    x = codes - codes.mean()
    v = float((x * x).sum())
    r = float((x[1:] * x[:-1]).sum()) / v if v > 0 else 1.0
    p3 = _normal_tail((r - null.serial) * math.sqrt(n))
    half = -sum(math.log(max(p, 1e-300)) for p in (p1, p2, p3))
    return math.exp(-half) * (1 + half + half * half / 2)


def infer(token: str) -> tuple[int, int, np.ndarray] | None:
    """Place and size of the smallest encoding that holds a token, and its codes; None without a letter or a digit."""
    raw = np.frombuffer(token.rstrip("=").encode(), np.uint8)
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    if len(raw) < 16 or not letter.any() or not ((raw >= 48) & (raw <= 57)).any():
        return None
    for i, (_, m, table) in enumerate(CODES):
        codes = table[raw]
        if codes.max() < 255:
            return i, m, codes.astype(np.int64)
    return None


def candidates(text: str, taken: list) -> list[tuple[int, int, str]]:
    """``(start, end, token)`` of tokens to test, outside the fixed patterns' matches, which are sorted by start."""
    starts = [s for s, _, _ in taken]
    reach, far = [], 0
    for _, _, e in taken:
        far = max(far, e)
        reach.append(far)
    out = []
    for m in CANDIDATE.finditer(text):
        before = bisect_left(starts, m.end())
        if not before or reach[before - 1] <= m.start():
            out.append((m.start(), m.end(), m[0]))
    return out


def weight(n: int) -> float:
    """A long token has more to tell; weights are divided by their mean over all candidates."""
    return math.log2(n)


def evidence(token: str, pairs: np.ndarray, text: tuple[Null, ...], alpha: float) -> float | None:
    """-log10 of the battery's p-value against text; None if it is no candidate.

    0 if the battery tells the token from uniform symbols, or the letter pairs do not tell it from text.
    """
    if (found := infer(token)) is None:
        return None
    encoding, m, codes = found
    at = TABLE[np.frombuffer(token.rstrip("=").encode(), np.uint8)].astype(np.int64)
    p = against_text(at, codes, text[encoding])
    if p > alpha or battery(codes, m) < alpha:
        return 0.0
    written = pairs[OTHER, at[0]] + pairs[at[:-1], at[1:]].sum()
    if -len(at) * math.log10(m) - math.log10(len(CODES)) - written < -math.log10(alpha):
        return 0.0
    return min(-math.log10(max(p, 1e-300)), TOP)


def _gather(batches):
    schema = pa.schema([("token", pa.string()), ("pairs", pa.list_(pa.int64()))])
    for batch in batches:
        counts = np.zeros(CLASSES * CLASSES, np.int64)
        tokens = []
        for text in batch.column(0):
            text = text.as_py() or ""
            at = TABLE[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)].astype(np.uint16)
            at = np.concatenate(([OTHER], at, [OTHER])).astype(np.uint16)
            counts += np.bincount(at[:-1] * np.uint16(CLASSES) + at[1:], minlength=CLASSES * CLASSES)
            tokens += [t for _, _, t in candidates(text, base_spans(text)) if infer(t)]
        yield pa.RecordBatch.from_pydict({"token": [*tokens, None], "pairs": [*[None] * len(tokens), counts]}, schema)


def fit(docs: DataFrame, text: str = "text", rate: float = 0.01, alpha: float = ALPHA) -> Model:
    """Pair model and false-discovery cut over all texts.

    To the driver come sums only: one number per letter pair, and one per step of -log10(p).
    """
    gathered = materialize(docs.select(text_of(text)).mapInArrow(_gather, "token string, pairs array<bigint>"), "secrets")
    counts = np.ones(CLASSES * CLASSES)
    for i, n in gathered.where("pairs is not null").select(F.posexplode("pairs")).groupBy("pos").agg(F.sum("col")).collect():
        counts[i] += n
    counts = counts.reshape(CLASSES, CLASSES)
    single = counts.sum(0) / counts.sum()
    pairs = np.log10((counts + BACK_OFF * single) / (counts.sum(1, keepdims=True) + BACK_OFF))
    written = nulls(counts)

    @F.arrow_udf("double")
    def scores(token: pa.Array) -> pa.Array:
        return pa.array([evidence(t, pairs, written, alpha) for t in token.to_pylist()], pa.float64())

    found = gathered.where("token is not null").select(scores("token").alias("p"), F.log2(F.length("token")).alias("w"))
    found = materialize(found, "secrets-p")
    total, mean = found.agg(F.count("*"), F.avg("w")).first()
    if not total:
        return Model(pairs, written, 1.0, math.inf)
    at = F.greatest(F.floor((F.col("p") + F.log10(F.col("w") / mean)) / STEP), F.lit(0)).alias("at")
    above, cut = 0, math.inf
    for step, n in sorted(found.groupBy(at).count().collect(), reverse=True):
        above += n
        if 10 ** (-step * STEP) <= rate * above / total:
            cut = step * STEP
    return Model(pairs, written, mean, cut)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find(text: Column, model: Model, alpha: float = ALPHA) -> Column:
    """Struct of ``base`` and ``more``: arrays of ``(kind, start, end)`` by start, in code points."""
    kinds = list(ORDER)

    @F.arrow_udf(f"struct<base:{SPANS},more:{SPANS}>")
    def spans(texts: pa.Array) -> pa.Array:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        out = []
        for value in texts:
            t = value.as_py() or ""
            base, more = base_spans(t), []
            for s, e, token in candidates(t, base):
                p = evidence(token, model.pairs, model.nulls, alpha)
                if p is not None and max(math.floor((p + math.log10(weight(len(token)) / model.mean_weight)) / STEP), 0) * STEP >= model.cut:
                    more.append({"kind": "random", "start": s, "end": e})
            out.append({"base": [{"kind": kinds[k], "start": s, "end": e} for s, k, e in base], "more": more})
        return pa.array(out, pa.struct([("base", span), ("more", span)]))

    return spans(text)


def secrets(docs: DataFrame, text: str = "text", rate: float = 0.01, alpha: float = ALPHA) -> DataFrame:
    """``docs`` with ``base`` and ``more``, arrays of ``(kind, start, end)``.

    Null and empty texts have no spans, repeated rows are marked alike, an empty table stays
    empty, and input columns called ``base`` or ``more`` are replaced.
    """
    found = find(text_of(text), fit(docs, text, rate, alpha), alpha)
    return docs.withColumn("base", found).withColumns({"more": F.col("base.more"), "base": F.col("base.base")})


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span (sorted, possibly overlapping) replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substr(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        put = F.when(s["start"] >= a["at"], F.concat(gap, F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], put).alias("out"))

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substr(text, done["at"] + 1)))
