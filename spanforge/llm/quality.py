"""Quality by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1 outside the held-out fold; negatives are never
read. A linear model on hinges of text statistics is fitted in two steps: positives against
unlabelled text first, from whose scores on rows held back the class prior is estimated (the least
ratio of unlabelled to positive mass above a threshold, with a confidence margin), then the
non-negative unbiased risk  pi R_p(+) + max(0, R_u(-) - pi R_p(-))  with logistic loss. Where the
second term turns negative its gradient is reversed, which keeps a flexible model from fitting
positives found in the unlabelled sample.
"""

import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

FOLDS, HELD_OUT = 4, 2
#: Bounds of the fitting samples: labelled positives, and unlabelled texts (about so many rows).
POSITIVES, UNLABELLED = 8_000, 8_000
THRESHOLD = 0.7
GRAIN = 1 << 30

NAMES = (
    "words", "word_length", "distinct_words", "distinct_pairs", "repeats", "upper", "digit", "space", "line_words", "distinct_lines", "stops", "commas",
    "marks", "bars", "symbols", "other_punctuation", "not_ascii", "longest_word", "title_words", "top_word",
)

_KINDS = ("lower", "upper", "digit", "space", "newline", "stop", "comma", "mark", "bar", "symbol", "punctuation", "high")
_CLASS = np.full(256, _KINDS.index("punctuation"), np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
for _c in b" \t\r\x0b\x0c":
    _CLASS[_c] = 3
_CLASS[10] = 4
for _chars, _k in ((b".", 5), (b",;:", 6), (b"!?", 7), (b"|", 8), (b"#$%&*@^~+=<>\\_/{}[]", 9)):
    for _c in _chars:
        _CLASS[_c] = _k
_CLASS[128:] = _KINDS.index("high")


def statistics(text: str) -> list[float]:
    """Whole-text statistics in the order of NAMES; all zero for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    c = np.bincount(_CLASS[raw], minlength=len(_KINDS)).astype(float)
    kinds = dict(zip(_KINDS, c, strict=True))
    letters = max(1.0, kinds["lower"] + kinds["upper"] + kinds["high"])
    total = float(len(raw))
    lines = text.split("\n")
    counts = Counter(words)
    distinct = counts.keys()
    return [
        np.log1p(n),
        len(text) / n,
        len(distinct) / n**0.9,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
        sum(map(operator.eq, words, words[1:])) / n,
        kinds["upper"] / letters,
        kinds["digit"] / total,
        kinds["space"] / total,
        np.log1p(n / len(lines)),
        len(set(lines)) / len(lines),
        kinds["stop"] / n,
        kinds["comma"] / n,
        kinds["mark"] / n,
        kinds["bar"] / n,
        kinds["symbol"] / n,
        kinds["punctuation"] / n,
        kinds["high"] / total,
        np.log1p(max(map(len, distinct))),
        sum(map(str.istitle, distinct)) / len(distinct),
        max(counts.values()) / n,
    ]


@dataclass(frozen=True)
class Model:
    knots: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def basis(self, x: np.ndarray) -> np.ndarray:
        hinges = np.maximum(0.0, x[:, :, None] - self.knots[None]).reshape(len(x), -1)
        return np.clip((np.hstack((x, hinges)) - self.mean) / self.scale, -8, 8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.basis(x)
        return _sigmoid(z @ self.weights[:-1] + self.weights[-1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(gradient, width: int, steps: int, rate: float, decay: float) -> np.ndarray:
    """Adam on all rows at once."""
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        g = gradient(w)
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _linear(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    return z @ w[:-1] + w[-1]


def _pull(z: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.append(z.T @ by, by.sum()) / len(z)


def class_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1) -> float:
    """Least ratio of unlabelled to positive mass above a threshold, chosen with a confidence margin."""
    cuts = np.unique(np.quantile(p, np.linspace(0.0, 0.95, 96)))
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts, "left") / len(x)
    qp, qu = above(p), above(u)
    margin = np.sqrt(np.log(4 / delta) / (2 * len(u))) + np.sqrt(np.log(4 / delta) / (2 * len(p)))
    best = np.argmin((qu + margin) / np.maximum(qp, 1e-9))
    return float(np.clip(qu[best] / qp[best], 0.01, 0.99))


def train(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 300) -> Model:
    """Fit on statistics of trusted positives and of unlabelled texts."""
    both = np.vstack((positive, unlabelled))
    knots = np.quantile(both, (0.05, 0.25, 0.5, 0.75, 0.95), axis=0).T
    model = Model(knots, np.zeros(1), np.ones(1), np.zeros(1), 0.5)
    hinges = np.hstack((both, np.maximum(0.0, both[:, :, None] - knots[None]).reshape(len(both), -1)))
    model = Model(knots, hinges.mean(0), hinges.std(0) + 1e-6, np.zeros(1), 0.5)
    zp, zu = model.basis(positive), model.basis(unlabelled)
    ap, bp, au, bu = zp[::2], zp[1::2], zu[::2], zu[1::2]
    if not len(bp) or not len(bu):
        ap, bp, au, bu = zp, zp, zu, zu
    against = _descend(lambda w: 0.5 * _pull(ap, _sigmoid(_linear(ap, w)) - 1) + 0.5 * _pull(au, _sigmoid(_linear(au, w))), zp.shape[1], steps, 0.02, 1e-3)
    prior = class_prior(_linear(bp, against), _linear(bu, against))

    def risk(w: np.ndarray) -> np.ndarray:
        fp, fu = _linear(zp, w), _linear(zu, w)
        plus = prior * _pull(zp, _sigmoid(fp) - 1)
        minus = _pull(zu, _sigmoid(fu)) - prior * _pull(zp, _sigmoid(fp))
        value = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        return plus + minus if value >= 0 else -minus

    return Model(model.knots, model.mean, model.scale, _descend(risk, zp.shape[1], steps, 0.03, 1e-4), prior)


def held_out(key: str | Column) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _rows(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t.as_py() or "") for t in batch.column(1)], pa.list_(pa.float64()))], ["doc_id", "x"])


def _sample(key: str, bound: int, count: int) -> Column:
    """Rows of smallest hash of their key, about ``bound`` of ``count``."""
    return F.pmod(F.xxhash64(key), F.lit(GRAIN)) < int(GRAIN * min(1.0, bound / max(1, count)))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Model from at most about ``positives`` labelled and ``unlabelled`` other rows; None without either.

    Only labels outside the held-out fold are read. A document counts as positive if all its
    labels say so, and as unlabelled if it has no label and is not in the held-out fold.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).where(~held_out("doc_id"))
    good = labels.where(~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select(F.col("doc_id").cast("bigint").alias("doc_id"))
    good = good.where(_sample("doc_id", positives, good.count()))
    n = docs.count()
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id")).where(_sample("doc_id", unlabelled, n))
    rest = docs.where(_sample("doc_id", unlabelled, n)).join(known, "doc_id", "left_anti")

    def collected(df: DataFrame) -> np.ndarray:
        # a bounded sample of short rows of statistics; in a fixed order, so that the fit repeats
        found = sorted((r.doc_id is None, r.doc_id or 0, r.x) for r in df.select("doc_id", "text").mapInArrow(_rows, "doc_id bigint, x array<double>").collect())
        return np.array([x for *_, x in found]).reshape(-1, len(NAMES))

    p = collected(docs.join(F.broadcast(good), "doc_id", "left_semi"))
    u = collected(rest)
    return train(p, u) if len(p) and len(u) else None


def score(text: Column, model: Model | None) -> Column:
    """Chance of label 1 of each text; 0.5 if there is no model."""
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t.as_py() or "") for t in texts]).reshape(-1, len(NAMES))
        return pa.array(np.concatenate([model.scores(x[i : i + 1024]) for i in range(0, len(x), 1024)]) if len(x) else [], pa.float64())

    return scored(text)


def quality(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of each row of ``docs``.

    Null and empty texts are scored by their (zero) statistics; rows that repeat are scored alike;
    null ids are in no fold; without a positive or an unlabelled row every score is 0.5; an empty
    table gives no rows; other columns are not read.
    """
    model = fit(docs, labels, **bounds)
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), score(text_of(), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
