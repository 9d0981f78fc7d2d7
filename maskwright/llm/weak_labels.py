"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation
finds how often each labeller is right and how likely each combination of votes is good; these
posterior labels, not human ones, train a linear scorer on hashed byte trigrams.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.batches import grams, map_texts
from maskwright.llm.sampling import HASH, once, sampled

NOTHING, BAD, GOOD = 0, 1, 2
BITS = 14
# Largest number of distinct texts that train the scorer.
SAMPLE = 8000

_SPACE, _LOWER, _UPPER, _DIGIT, _LONG, _STOP, _COMMA, _MARK, _BAR, _OTHER = range(10)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
for _chars, _kind in (
    (b" \t\n\x0b\x0c\r", _SPACE),
    (bytes(range(97, 123)), _LOWER),
    (bytes(range(65, 91)), _UPPER),
    (b"0123456789", _DIGIT),
    (bytes(range(128, 256)), _LONG),
    (b".?", _STOP),
    (b",;:'\"()-", _COMMA),
    (b"!", _MARK),
    (b"|", _BAR),
):
    _CLASS[list(_chars)] = _kind

# Defects, each voting bad or nothing; the last votes good or nothing.
DEFECTS = ["empty", "capitals", "symbols", "exclamation", "tables", "digits", "lines", "words", "stutter", "variety"]
LABELLERS = [*DEFECTS, "clean"]


def votes(text: str | None) -> list[int]:
    """One vote per labeller. A text without words is bad to ``empty`` and nothing to the others.

    A defect is voted bad above a high rate; ``clean`` votes good where all rates are low. ``variety`` is
    about repeated words, of at least 50.
    """
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    if not n:
        return [BAD, *[NOTHING] * (len(LABELLERS) - 1)]
    kinds = np.bincount(_CLASS[np.frombuffer(data, dtype=np.uint8)], minlength=10)
    solid = len(data) - int(kinds[_SPACE])
    letters = int(kinds[_LOWER] + kinds[_UPPER] + kinds[_LONG])
    lines = [x for x in data.split(b"\n") if x.strip()]
    mean = solid / n
    rates = [  # rate, where it is a defect, where it is low
        (0.0, 1.0, 1.0),
        (kinds[_UPPER] / max(1, letters), 0.4, 0.2),
        (kinds[_OTHER] / solid, 0.1, 0.03),
        (kinds[_MARK] / n, 0.2, 0.05),
        (kinds[_BAR] / n, 0.1, 0.03),
        (kinds[_DIGIT] / solid, 0.3, 0.1),
        (1 - len(set(lines)) / len(lines), 0.4, 0.2),
        (abs(mean - 8) / 8, 1.5, 0.75),
        (sum(map(bytes.__eq__, words, words[1:])) / n, 0.2, 0.05),
        (1 - len(set(words)) / n if n >= 50 else 0.0, 0.8, 0.7),
    ]
    return [
        *(BAD if amount > high else NOTHING for amount, high, _ in rates),
        GOOD if all(amount <= low for amount, _, low in rates) else NOTHING,
    ]


@dataclass
class LabelModel:
    prior: float  # share of good texts
    right: np.ndarray  # [labeller, class (bad, good), vote]: how likely a vote is in a class

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good per row of votes."""
        z = np.full(len(patterns), np.log(self.prior) - np.log1p(-self.prior))
        for k in range(len(self.right)):
            ratio = np.log(self.right[k, 1]) - np.log(self.right[k, 0])
            z += ratio[patterns[:, k]]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, *, rounds: int = 100) -> LabelModel:
    """EM over the distinct combinations of votes and how often they occur.

    A labeller starts as right four times out of five when it votes, and as silent half of the time in
    either class. Without rows the start is the result.
    """
    k = patterns.shape[1]
    right = np.tile(np.array([[0.5, 0.4, 0.1], [0.5, 0.1, 0.4]]), (k, 1, 1))
    model = LabelModel(0.8, right)
    if not len(patterns):
        return model
    weight = counts.astype(float)
    for _ in range(rounds):
        good = model.posterior(patterns)
        share = np.stack([weight * (1 - good), weight * good])
        new = np.empty_like(right)
        for j in range(k):
            for c in range(2):
                seen = np.bincount(patterns[:, j], share[c], minlength=3) + 1.0
                new[j, c] = seen / seen.sum()
        prior = float(np.clip((share[1].sum() + 1) / (weight.sum() + 2), 1e-3, 1 - 1e-3))
        done = np.abs(new - model.right).max() < 1e-6
        model = LabelModel(prior, new)
        if done:
            break
    return model


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of byte trigrams and their weights, of length one together."""
    total = np.zeros(1 << BITS, dtype=np.int64)
    for code, _ in grams(np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8), 3, BITS):
        total += np.bincount(code, minlength=1 << BITS)
    at = np.flatnonzero(total)
    value = np.log1p(total[at])
    return at, value / max(1e-9, float(np.sqrt((value**2).sum())))


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, copies: np.ndarray | None = None, *, rounds: int = 300, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam: weights by bucket and the bias. A row counts as often as
    ``copies`` says, once without it."""
    size = 1 << BITS
    theta, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    if not rows:
        return theta[:size], 0.0
    col = np.concatenate([r[0] for r in rows])
    val = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    share = np.full(len(rows), 1 / len(rows)) if copies is None else copies / copies.sum()
    for step in range(1, rounds + 1):
        z = np.bincount(row, theta[col] * val, len(rows)) + theta[size]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * share
        g = np.append(np.bincount(col, d[row] * val, size) + decay * theta[:size], d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:size], float(theta[size])


@dataclass
class Model:
    labels: LabelModel
    weight: np.ndarray
    bias: float


def _voted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def work(texts: list[str | None]) -> list:
        return [pa.array(["".join(map(str, votes(t))) for t in texts])]

    return map_texts(docs, id_col, text_col, [T.StructField("votes", T.StringType())], work)


def _patterns(rows: list[str]) -> np.ndarray:
    return np.array([[int(c) for c in r] for r in rows], dtype=np.int64).reshape(-1, len(LABELLERS))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Count vote combinations over all rows (at most 3 ** number of labellers reach the driver), fit
    the label model, then train the scorer on at most ``sample`` distinct texts with their posterior
    labels, each with the number of rows that it stands for as its weight.

    However many copies a text has, one of them trains, and however long it is. The driver gets the cells of
    ``sample`` texts, of at most ``2 ** BITS`` each.
    """
    seen = _voted(docs, id_col, text_col).groupBy("votes").count().collect()
    patterns, counts = _patterns([r["votes"] for r in seen]), np.array([r["count"] for r in seen])
    labels = fit_labels(patterns, counts)
    texts = docs.select(F.col(text_col).cast("string").alias("_text")).where("_text IS NOT NULL")
    texts = texts.select(F.expr(HASH.format("_text")).alias("_hash"), "_text")
    copies = sampled(texts, sample)

    def work(own: list[str]) -> list:
        cells = [features(t) for t in own]
        return [
            pa.array([c.astype(np.int32).tobytes() for c, _ in cells], pa.binary()),
            pa.array([x.astype(np.float32).tobytes() for _, x in cells], pa.binary()),
            pa.array(["".join(map(str, votes(t))) for t in own]),
        ]

    found = once(texts, list(copies), ["at", "value", "votes"], "at binary, value binary, votes string", work)
    got = found.toPandas().sort_values("_hash")
    rows = [
        (np.frombuffer(a, dtype=np.int32), np.frombuffer(x, dtype=np.float32).astype(float))
        for a, x in zip(got["at"], got["value"], strict=True)
    ]
    weight, bias = train(rows, labels.posterior(_patterns(list(got["votes"]))), np.array([copies[h] for h in got["_hash"]]))
    return Model(labels, weight.astype(np.float32), bias)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, votes, posterior (of the votes), score (of the scorer), predicted.

    Null and empty texts have no trigrams: their score is that of the bias, their votes are those of an
    empty text. Texts are scored whole; null and repeated ids are kept; other columns are not read.
    """
    labels, weight, bias = model.labels, model.weight, model.bias

    def work(texts: list[str | None]) -> list:
        cast = [votes(t) for t in texts]
        z = np.array([bias + float(weight[at] @ value) for at, value in map(features, texts)])
        s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        good = labels.posterior(np.array(cast, dtype=np.int64).reshape(-1, len(LABELLERS)))
        return [pa.array(["".join(map(str, c)) for c in cast]), good, s, (s >= 0.5).astype(np.int32)]

    fields = [
        T.StructField("votes", T.StringType()),
        T.StructField("posterior", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
    ]
    return map_texts(docs, id_col, text_col, fields, work)
