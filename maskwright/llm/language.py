"""Language identification by mixture inference.

Every language is a categorical distribution over hashed byte n-grams, counted over all labelled
texts. A document is a mixture of languages: expectation-maximisation finds the proportions, and the
set of languages is chosen by penalised likelihood, as most documents need one language only. A text
of nothing but letters that stand alone has no n-gram; its language is the likeliest one by how often
these letters are words of a language and by the share of training rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.batches import grams, letters, map_texts, sum_blocks

NONE = "und"
_WORD_LIKE = re.compile(r"[^\W\d_]+")


def _has_letter(text: str) -> bool:
    """Has it a character of a letter category? Number signs such as ``½`` or ``Ⅷ`` are none."""
    return any(any(map(str.isalpha, run.group())) for run in _WORD_LIKE.finditer(text))


@dataclass
class Model:
    """``likelihood[g, l]``: probability of n-gram bucket g in language l; ``alone[b, l]``: probability that
    a word of it is the byte b; ``share[l]``: share of the training rows."""

    names: list[str]
    likelihood: np.ndarray
    n: int
    bits: int
    alone: np.ndarray
    share: np.ndarray


def _counts(text: str, n: int, bits: int) -> np.ndarray:
    """Occurrences by bucket; n-grams that hold two spaces in a row are left out."""
    total = np.zeros(1 << bits, dtype=np.int64)
    for code, piece in grams(letters(text), n, bits):
        blank = piece == 32
        pairs = blank[:-1] & blank[1:]
        bad = np.zeros(len(code), dtype=bool)
        for k in range(n - 1):
            bad |= pairs[k : k + len(code)]
        total += np.bincount(code[~bad], minlength=1 << bits)
    return total


def _alone(data: np.ndarray) -> np.ndarray:
    """Occurrences of each byte between two spaces, in a text as ``letters`` gives it."""
    blank = data == 32
    return np.bincount(data[1:-1][blank[:-2] & ~blank[1:-1] & blank[2:]], minlength=256)


def _short(text: str) -> np.ndarray:
    """256 counts of bytes that stand alone, the number of words, and 1 for the row."""
    data = letters(text)
    blank = data == 32
    return np.append(_alone(data), [np.count_nonzero(blank[:-1] & ~blank[1:]), 1])


def fit(
    docs: DataFrame,
    training: Column,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    n: int = 4,
    bits: int = 16,
    smoothing: float = 0.5,
    block: int = 4096,
) -> Model:
    """Count n-grams per language over all rows that meet ``training`` and have a text and a language.

    Tasks count; blocks of buckets are summed on the cluster. What reaches the driver is the model:
    2**bits + 258 counts per language, however many rows there are.
    """
    rows = docs.where(training).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in held:
                    held[lang] = np.zeros(size + 258, dtype=np.int64)
                held[lang][:size] += _counts(text, n, bits)
                held[lang][size:] += _short(text)
        salt = TaskContext.get().partitionId()
        for lang, total in held.items():
            at = [*range(0, size, block), size]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(at)),
                    pa.array(at, pa.int32()),
                    pa.array([salt] * len(at), pa.int64()),
                    pa.array([total[a : b].tobytes() for a, b in zip(at, [*at[1:], size + 258], strict=True)], pa.binary()),
                ],
                names=["lang", "at", "salt", "counts"],
            )

    parts = rows.mapInArrow(count, "lang string, at int, salt bigint, counts binary")
    found = sum_blocks(parts, ["lang", "at"]).collect()
    names = sorted({r.lang for r in found})
    both = np.zeros((size + 258, max(1, len(names))))
    for r in found:
        part = np.frombuffer(r.counts, dtype=np.int64)
        both[r.at : r.at + len(part), names.index(r.lang)] = part
    counts, alone, words, share = both[:size] + smoothing, both[size:-2] + smoothing, both[-2], both[-1]
    return Model(names, counts / counts.sum(axis=0), n, bits, alone / (words + 256 * smoothing), share / max(1.0, share.sum()))


def _fit_mixture(p: np.ndarray, c: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """EM for the proportions of the languages in the columns of ``p``; the log-likelihood reached."""
    total = c.sum()
    for _ in range(rounds):
        new = pi * (p.T @ (c / (p @ pi))) / total
        done = np.abs(new - pi).max() < 1e-3
        pi = new
        if done:
            break
    return pi, float(c @ np.log(p @ pi))


def _likeliest(model: Model, text: str) -> dict[str, float]:
    """The likeliest language by share and by the letters that stand alone, and its probability."""
    data = letters(text)
    if (data == 32).all():
        return {}
    z = np.log(model.share) + _alone(data) @ np.log(model.alone)
    p = np.exp(z - z.max())
    first = int(np.argmax(p))
    return {model.names[first]: float(p[first] / p.sum())}


def mixture(model: Model, text: str, *, rounds: int = 30, penalty: float = 4.0) -> dict[str, float]:
    """Proportions of the languages chosen for one text, the largest first.

    Starts with all languages, then compares the sets of the k strongest, k = 1, 2, ...; a further
    language must raise the log-likelihood by ``penalty * log(number of n-grams)``. Equal likelihoods
    go to the language that sorts first. A text without n-grams, whose letters all stand alone, gets the
    likeliest language alone, with its probability; one without letters gets none.
    """
    if not model.names:
        return {}
    counts = _counts(text, model.n, model.bits)
    at = np.flatnonzero(counts)
    if not len(at):
        return _likeliest(model, text)
    c, p = counts[at].astype(float), model.likelihood[at]
    k = len(model.names)
    single = c @ np.log(p)
    first = int(np.argmax(single))
    best, chosen = float(single[first]), {first: 1.0}
    if k > 1:
        pi, _ = _fit_mixture(p, c, np.full(k, 1 / k), rounds)
        rank = [first, *(int(j) for j in np.argsort(-pi, kind="stable") if j != first)]
        cost = penalty * np.log(c.sum() + 1)
        for size in range(2, k + 1):
            use = rank[:size]
            start = np.maximum(pi[use], 1e-3)
            part, likelihood = _fit_mixture(p[:, use], c, start / start.sum(), rounds)
            if likelihood - best <= cost:
                break
            best, chosen = likelihood, dict(zip(use, map(float, part), strict=True))
    order = sorted(chosen, key=lambda j: (-chosen[j], model.names[j]))
    return {model.names[j]: chosen[j] for j in order}


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score, languages, proportions.

    ``score`` is the proportion of ``lang_pred``, for a text whose letters all stand alone ('A.') its
    probability. A null text, a text without letters (an empty one too) and a model without languages
    give ``und`` with score 0. Texts are used whole, whatever
    their length; null and repeated ids are kept; the rest of the columns is not read.
    """

    def work(texts: list[str | None]) -> list:
        found = [mixture(model, t) if t and _has_letter(t) else {} for t in texts]
        return [
            [next(iter(m), NONE) for m in found],
            [min(1.0, max(0.0, next(iter(m.values()), 0.0))) for m in found],
            pa.array([list(m) for m in found], pa.list_(pa.string())),
            pa.array([list(m.values()) for m in found], pa.list_(pa.float64())),
        ]

    fields = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("languages", T.ArrayType(T.StringType())),
        T.StructField("proportions", T.ArrayType(T.DoubleType())),
    ]
    return map_texts(docs, id_col, text_col, fields, work)
