"""Helpers for work on batches of texts inside tasks.

Spark cuts Arrow batches by rows and by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``), so a
batch is bounded but for a single text that is longer than the bound. Texts are taken whole; arrays
over their bytes are built in pieces of ``PIECE`` bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = 1 << 20

# Odd 32-bit multipliers of the hash of a byte n-gram.
_FACTORS = (2654435761 * np.arange(1, 17, dtype=np.uint64) + 0x7F4A7C15).astype(np.uint32) | np.uint32(1)

# Bytes of running text: ASCII letters in lower case and all bytes of longer characters stay, all else is a space.
_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[128:] = np.arange(128, 256)
for _b in range(ord("a"), ord("z") + 1):
    _LETTERS[_b] = _LETTERS[_b - 32] = _b


def map_texts(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    fields: list[T.StructField],
    work: Callable[[list[str | None]], list],
) -> DataFrame:
    """Apply ``work`` to every batch of texts; its arrays become the columns beside the id.

    Only the two named columns are read, so other columns may have any name. Rows keep their id,
    null ids and repeated ids included.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = work(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def letters(text: str) -> np.ndarray:
    """The bytes of ``text`` in lower case, with a space for all that is no letter, between two spaces."""
    return _LETTERS[np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", dtype=np.uint8)]


def grams(data: np.ndarray, n: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash of the ``n`` bytes from each position on, and these positions' bytes, piece by piece."""
    for at in range(0, max(0, len(data) - n + 1), PIECE):
        piece = data[at : at + PIECE + n - 1]
        m = len(piece) - n + 1
        wide = piece.astype(np.uint32)
        code = wide[:m] * _FACTORS[0]
        for k in range(1, n):
            code += wide[k : k + m] * _FACTORS[k]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        yield code >> np.uint32(32 - bits), piece


def sum_blocks(rows: DataFrame, keys: list[str], salt: str = "salt", value: str = "counts") -> DataFrame:
    """Add up binary int64 arrays of equal length per key, in two steps of bounded fan-in.

    ``salt`` holds the number of the task that made a row; 512 tasks meet in the first step.
    """

    def add(frame):
        head = frame.iloc[[0]].copy()
        total = sum(np.frombuffer(x, dtype=np.int64) for x in frame[value])
        head[value] = [total.tobytes()]
        return head

    first = rows.withColumn(salt, F.expr(f"{salt} div 512"))
    first = first.groupBy(*keys, salt).applyInPandas(add, first.schema)
    return first.groupBy(*keys).applyInPandas(add, first.schema).drop(salt)
