"""Bounded samples of distinct texts, the same in every run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The hash by which texts are told apart and drawn.
HASH = "xxhash64({}, 'sample')"


def sampled(texts: DataFrame, sample: int) -> dict[int, float]:
    """Hashes (column ``_hash``) of at most ``sample`` distinct texts and for how many rows each stands.

    Priority sampling: the texts with the least hash per copy. With texts left out, one stands for as many
    rows as its copies or the bound of the priorities say, whichever is more: a text with very many copies
    comes in and counts as them all, but not for other rows too.
    """
    counts = texts.groupBy("_hash").agg(F.count("*").alias("n"))
    priority = F.expr("(shiftrightunsigned(_hash, 11) + 1) / 9007199254740992D / n")
    least = counts.select(priority.alias("p"), "_hash", "n").orderBy("p", "_hash").limit(sample + 1).collect()
    bound = 1 / least[sample]["p"] if len(least) > sample else 0.0
    return {r["_hash"]: max(float(r["n"]), bound) for r in least[:sample]}


def once(texts: DataFrame, hashes: list[int], names: list[str], types: str, work: Callable[[list[str]], list]) -> DataFrame:
    """What ``work`` makes of each text (columns ``_hash``, ``_text``) whose hash is among ``hashes``, once each.

    ``hashes`` is a bounded sample, so it goes to all tasks; texts are not shuffled.
    """
    chosen = texts.sparkSession.createDataFrame([(h,) for h in hashes], "_hash bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            new = []
            for k, h in enumerate(batch.column(0).to_pylist()):
                if h not in done:
                    done.add(h)
                    new.append(k)
            if new:
                some = batch.take(pa.array(new))
                yield pa.RecordBatch.from_arrays([some.column(0), *work(some.column(1).to_pylist())], names=["_hash", *names])

    found = texts.select("_hash", "_text").join(F.broadcast(chosen), "_hash", "left_semi").mapInArrow(run, f"_hash bigint, {types}")
    return found.groupBy("_hash").agg(F.min(F.struct(*names)).alias("x")).select("_hash", "x.*")
