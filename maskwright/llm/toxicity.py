"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; unlabelled text, whatever it holds, stands for the whole
population. With the class prior p the risk of a scorer is p R+ + max(0, Ru- - p R-), where the
second term estimates the risk on the clean part and may not turn negative.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.batches import grams, letters, map_texts
from maskwright.llm.sampling import HASH, once, sampled
from maskwright.llm.storage import stored

N = 5
BEGINNINGS = (6, 7, 8, 10)
BITS = 32
# Least number of sampled positives that hold a chosen n-gram, and how sure, in standard deviations,
# its surplus among them must be.
LEAST = 5
SURE = 4.0
# Step back on the clean part, as a share of a step, where its estimated risk is below zero.
BACK = 0.1
# Largest numbers of sampled texts and of chosen n-grams.
POSITIVES = 3000
UNLABELLED = 6000
FEATURES = 1 << 18


@dataclass
class Model:
    codes: np.ndarray  # chosen n-grams by their hash, sorted
    weight: np.ndarray
    bias: float
    prior: float

    def logit(self, text: str | None) -> float:
        found = features(text)
        if not len(self.codes) or not len(found):
            return self.bias
        at = np.minimum(np.searchsorted(self.codes, found), len(self.codes) - 1)
        return self.bias + float(self.weight[at[self.codes[at] == found]].sum())


def features(text: str | None) -> np.ndarray:
    """Distinct hashes of the byte 5-grams inside words, of which the first byte may be the space before
    one, and of the longer beginnings of words, that space included."""
    data = letters(text or "")
    found = [np.empty(0, dtype=np.uint32)]
    for code, piece in grams(data, N, BITS):
        blank = piece == 32
        inside = ~blank[1 : len(code) + 1]
        for k in range(2, N):
            inside &= ~blank[k : k + len(code)]
        found.append(np.unique(code[inside]))
    first = np.flatnonzero(data[:-1] == 32)
    for n in BEGINNINGS:
        first = first[first + n <= len(data)]
        first = first[(data[first + n - 1] != 32) & (data[first + 1] != 32)] if n == BEGINNINGS[0] else first[data[first + n - 1] != 32]
        code = np.full(len(first), n, dtype=np.uint32)
        for k in range(1, n):
            code = (code ^ data[first + k]) * np.uint32(0x01000193)
            code ^= code >> np.uint32(13)
        found.append(np.unique(code))
    return np.unique(np.concatenate(found))


def _surplus(p_count, u_count, positives: int, unlabelled: int):
    """By how many deviations of their pooled share n-grams are commoner in positives than in unlabelled texts."""
    pooled = (p_count + u_count) / (positives + unlabelled)
    deviation = np.sqrt(pooled * (1 - pooled) * (1 / positives + 1 / unlabelled) + 1e-12)
    return (p_count / positives - u_count / unlabelled) / deviation


def _select(pos: list[np.ndarray], unl: list[np.ndarray]) -> np.ndarray:
    """All n-grams that at least ``LEAST`` positives hold and whose share among positives surely exceeds that
    among unlabelled texts, sorted.

    The test is that of two proportions, so an n-gram that few positives hold, such as those of a rare
    language, is chosen if hardly any other text holds it.
    """
    p_code, p_count = np.unique(np.concatenate(pos), return_counts=True)
    u_code, u_count = np.unique(np.concatenate(unl), return_counts=True)
    if not len(p_code) or not len(u_code):
        return p_code[:0]
    at = np.minimum(np.searchsorted(u_code, p_code), len(u_code) - 1)
    u_count = np.where(u_code[at] == p_code, u_count[at], 0)
    return p_code[(p_count >= LEAST) & (_surplus(p_count, u_count, len(pos), len(unl)) > SURE)]


def _cells(chosen: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Positions of a text's n-grams among the chosen ones."""
    at = np.minimum(np.searchsorted(chosen, text), len(chosen) - 1)
    return at[chosen[at] == text].astype(np.int32)


def train(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, **how: float) -> Model:
    """Choose the n-grams of the sampled texts and learn their weights."""
    chosen = _select(pos, unl) if pos and unl else np.empty(0)
    if not len(chosen):
        return _constant(prior)
    pos, unl = ([_cells(chosen, t) for t in texts] for texts in (pos, unl))
    return learn(chosen, pos, unl, np.ones(len(pos)), np.ones(len(unl)), prior, **how)


def _constant(prior: float) -> Model:
    none = np.empty(0)
    return Model(none.astype(np.uint32), none, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))), prior)


def learn(
    chosen: np.ndarray,
    pos: list[np.ndarray],
    unl: list[np.ndarray],
    pos_rows: np.ndarray,
    unl_rows: np.ndarray,
    prior: float,
    *,
    rounds: int = 400,
    rate: float = 0.05,
    decay: float = 3e-5,
) -> Model:
    """Minimise the non-negative risk with the sigmoid loss by Adam; where the clean part's estimated
    risk is below zero, step back a little on that part instead. A text counts as the rows it stands for."""
    (pc, uc) = (np.concatenate(cells) for cells in (pos, unl))
    (pr, ur) = (np.repeat(np.arange(len(cells), dtype=np.int32), [len(c) for c in cells]) for cells in (pos, unl))
    wp, wu = pos_rows / pos_rows.sum(), unl_rows / unl_rows.sum()
    k = len(chosen)
    theta = np.zeros(k + 1)
    theta[k] = np.log(prior / (1 - prior))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, rounds + 1):
        zp = np.bincount(pr, theta[pc], len(wp)) + theta[k]
        zu = np.bincount(ur, theta[uc], len(wu)) + theta[k]
        sp, su = sigmoid(zp), sigmoid(zu)
        gp_neg, gu_neg = wp * sp * (1 - sp), wu * su * (1 - su)  # d/dz of the loss of calling a text clean ...
        gp_pos = -gp_neg  # ... and toxic
        clean = wu @ su - prior * (wp @ sp)
        sign = 1.0 if clean >= 0 else -BACK
        on_p = prior * gp_pos - sign * prior * gp_neg
        on_u = sign * gu_neg
        g = np.append(np.bincount(pc, on_p[pr], k) + np.bincount(uc, on_u[ur], k), on_p.sum() + on_u.sum())
        g[:k] += decay * theta[:k]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(chosen, theta[:k], float(theta[k]), prior)


def _counts(found: DataFrame) -> DataFrame:
    """How many sampled positives and unlabelled texts hold each n-gram; tasks count their own texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, dtype=np.uint32) for x in batch.column(2).to_pylist()]
            code = np.concatenate(sets)
            order = np.argsort(code, kind="stable")
            code, first = np.unique(code[order], return_index=True)
            tally = []
            for c in (0, 1):
                flags = np.repeat(np.array(batch.column(c).to_pylist(), dtype=np.int64), [len(s) for s in sets])[order]
                tally.append(np.add.reduceat(flags, first) if len(first) else flags)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), *map(pa.array, tally)], names=["code", "p", "u"])

    # a bounded sample: few tasks, so that most texts with an n-gram meet before the shuffle
    counted = found.select("positive", "unlabelled", "f").coalesce(8).mapInArrow(run, "code long, p long, u long")
    return counted.groupBy("code").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def _chosen(counts: DataFrame, positives: int, unlabelled: int, most: int) -> np.ndarray:
    """As ``_select``, on the cluster; the ``most`` surest if there are more."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sure = _surplus(frame["p"].to_numpy(), frame["u"].to_numpy(), positives, unlabelled)
            yield pd.DataFrame({"code": frame["code"], "sure": sure})[sure > SURE]

    surest = counts.where(f"p >= {LEAST}").mapInPandas(run, "code long, sure double").orderBy(F.desc("sure"), "code").limit(most)
    return np.sort(surest.select("code").toPandas()["code"].to_numpy().astype(np.uint32))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    training: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    features_at_most: int = FEATURES,
) -> Model:
    """Train on bounded samples of the rows that meet ``training`` (a condition on the id).

    The prior is the share of 1 among all labels of such rows. At most ``positives`` distinct texts with a
    label of 1 and ``unlabelled`` of all texts train, whatever their length, each as the rows that it stands
    for: repeated rows and repeated ids are no more than a weight. Rows with a label of 0 count as unlabelled
    text like all others. Repeated labels of an id count once (1 wins); null labels and null ids are ignored.
    N-grams are counted and chosen on the cluster; the driver gets the chosen ones, at most
    ``features_at_most``, and their places in the sampled texts.
    """
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .where("_id IS NOT NULL AND _y IS NOT NULL")
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
    )
    known = known.withColumnRenamed("_id", id_col).where(training).withColumnRenamed(id_col, "_id")
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    prior = min(0.9, max(0.001, toxic / n)) if n else 0.001
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), training.alias("_train"))
    texts = rows.where("_train AND _text IS NOT NULL").select("_id", F.expr(HASH.format("_text")).alias("_hash"), "_text")
    light = stored(texts.select("_id", "_hash"), "hashes")
    confirmed = light.join(known.where("_y = 1").select("_id"), "_id", "left_semi")
    pos_rows, unl_rows = sampled(confirmed, positives), sampled(light, unlabelled)
    if not pos_rows or not unl_rows:
        return _constant(prior)

    def work(own: list[str]) -> list:
        return [pa.array([features(t).astype(np.uint32).tobytes() for t in own], pa.binary())]

    found = once(texts, sorted({*pos_rows, *unl_rows}), ["f"], "f binary", work)
    sides = docs.sparkSession.createDataFrame(
        [(h, int(h in pos_rows), int(h in unl_rows)) for h in sorted({*pos_rows, *unl_rows})], "_hash long, positive int, unlabelled int"
    )
    found = stored(found.join(F.broadcast(sides), "_hash"), "features")
    chosen = _chosen(_counts(found), len(pos_rows), len(unl_rows), features_at_most)
    if not len(chosen):
        return _constant(prior)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [_cells(chosen, np.frombuffer(x, dtype=np.uint32)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], names=["_hash", "at"])

    got = found.select("_hash", "f").mapInArrow(place, "_hash long, at binary").toPandas().sort_values("_hash")
    cells = {h: np.frombuffer(x, dtype=np.int32) for h, x in zip(got["_hash"], got["at"], strict=True)}
    pos, unl = sorted(pos_rows), sorted(unl_rows)
    weights = (np.array([side[h] for h in keys]) for side, keys in ((pos_rows, pos), (unl_rows, unl)))
    return learn(chosen, [cells[h] for h in pos], [cells[h] for h in unl], *weights, prior)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: id, score (0 to 1), predicted (1 from ``threshold`` on).

    Every text is scored whole. Null and empty texts and texts without words get the score of the
    bias alone; null and repeated ids are kept; other columns are not read.
    """

    def work(texts: list[str | None]) -> list:
        z = np.array([model.logit(t) for t in texts])
        s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return [s, (s >= threshold).astype(np.int32)]

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return map_texts(docs, id_col, text_col, fields, work)
