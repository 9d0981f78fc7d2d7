"""Benchmark decontamination by the q-gram lemma.

A passage of m bytes within k edits of a region shares at least m + 1 - q - k q of its q-grams with
it, on diagonals at most k apart. Documents count shared q-grams in overlapping diagonal bands; bands
that reach the bound are kept, and verified by an alignment that stays inside the band.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.storage import stored

#: Edits allowed per byte of a passage.
RATE = 0.1
#: Bytes of a passage that are enough, or all of it if it has fewer. Stretches begin every half of this, so
#: any one and a half times as many bytes in a row hold one.
STRETCH = 160
#: Length of the q-grams of a stretch: the long ones from the second number of bytes on. Both leave every stretch
#: a bound of at least one shared q-gram at ``RATE``.
LONG_Q, LONG_FROM, SHORT_Q = 8, 40, 4
#: A benchmark is searched for in blocks of about this much text, each of which goes to all tasks.
BLOCK_BYTES = 2 << 20
_FILTER_BITS = 21
_EDIT = np.int64(1) << 32
_NEVER = np.int64(1) << 60

_SPAN = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("edits", T.IntegerType())])
_WORD = re.compile(r"\S+")


def normal(text: str) -> bytes:
    """Lower case, white space as single spaces."""
    return " ".join(text.lower().split()).encode("utf-8", "replace")


def codes(data: bytes, q: int) -> np.ndarray:
    """Each q-gram as the number its bytes make: exact, not hashed."""
    n = len(data) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for s in range(min(q, n)):
        out[s::q] = np.frombuffer(data, dtype=f"<u{q}", count=(n - s + q - 1) // q, offset=s)
    return out


def _slot(code: np.ndarray) -> np.ndarray:
    return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)


@dataclass
class Index:
    """Q-grams, all of one length, of the stretches of a block of passages."""

    q: int
    item: list[int | None]  # item id per stretch
    text: list[bytes]
    edits: np.ndarray  # budget per stretch
    bound: np.ndarray  # shared q-grams needed per stretch
    grams: np.ndarray  # distinct q-grams, sorted
    first: np.ndarray  # where a q-gram's places begin
    window: np.ndarray  # place: stretch
    offset: np.ndarray  # place: position in it
    maybe: np.ndarray  # filter over hashed q-grams


@dataclass
class Block:
    """What is searched for: stretches by the length of their q-grams, and passages of fewer bytes than any."""

    indexes: list[Index]
    tiny: dict[bytes, list[int | None]]


def build(items: list[tuple[int | None, str]]) -> Block:
    """Passages without any character but white space are searched for nowhere."""
    short: list[tuple[int | None, bytes]] = []
    long: list[tuple[int | None, bytes]] = []
    tiny: dict[bytes, list[int | None]] = {}
    for item, text in items:
        data = normal(text or "")
        last = max(0, len(data) - STRETCH)
        for s in sorted({*range(0, last, STRETCH // 2), last}):
            part = data[s : s + STRETCH]
            if len(part) >= SHORT_Q:
                (long if len(part) >= LONG_FROM else short).append((item, part))
            elif part:
                tiny.setdefault(part, []).append(item)
    return Block([_index(SHORT_Q, short), _index(LONG_Q, long)], tiny)


def _index(q: int, parts: list[tuple[int | None, bytes]]) -> Index:
    texts = [t for _, t in parts]
    m = np.array([len(t) for t in texts], dtype=np.int64)
    edits = (RATE * m).astype(np.int64)
    all_codes = [codes(t, q) for t in texts]
    flat = np.concatenate(all_codes) if texts else np.empty(0, dtype=np.uint64)
    window = np.repeat(np.arange(len(texts), dtype=np.int32), [len(c) for c in all_codes])
    offset = np.concatenate([np.arange(len(c), dtype=np.int32) for c in all_codes]) if texts else np.empty(0, dtype=np.int32)
    order = np.argsort(flat, kind="stable")
    distinct, first = np.unique(flat[order], return_index=True)
    maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
    maybe[_slot(distinct)] = True
    return Index(
        q, [i for i, _ in parts], texts, edits, m + 1 - q - edits * q, distinct,
        np.append(first, len(flat)), window[order], offset[order], maybe,
    )


def bands(index: Index, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, first diagonal) of the bands of a document that meet the bound of their stretch.

    Bands of a stretch are 2 (k + 1) diagonals wide and begin every k + 1, so the at most k + 1
    neighbouring diagonals of an alignment lie in one of them.
    """
    none = np.empty(0, dtype=np.int64)
    if not len(index.grams):
        return none, none
    code = codes(data, index.q)
    at = np.flatnonzero(index.maybe[_slot(code)])
    if not len(at):
        return none, none
    rank = np.minimum(np.searchsorted(index.grams, code[at]), len(index.grams) - 1)
    hit = index.grams[rank] == code[at]
    at, rank = at[hit], rank[hit]
    many = index.first[rank + 1] - index.first[rank]
    total = int(many.sum())
    place = np.repeat(index.first[rank] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(total) if total else np.empty(0, dtype=np.int64)
    window = index.window[place].astype(np.int64)
    step = index.edits[window] + 1
    band = (np.repeat(at, many) - index.offset[place]) // step
    key = (window << np.int64(40)) + band + (1 << 38)
    key, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
    window = key >> 40
    good = count >= index.bound[window]
    window = window[good]
    return window, ((key[good] & ((1 << 40) - 1)) - (1 << 38)) * (index.edits[window] + 1)


def verify(index: Index, docs: list[bytes], cases: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(edits, start, end) of the best alignment of each case (document, window, first diagonal) that stays
    in its band, over all cases at once, one passage byte after the other.

    A cell holds edits and start in one number, so the least of both wins. Column c of row p is
    document byte p + c of the band.
    """
    if not cases:
        return []
    doc, window, diagonal = (np.array(x, dtype=np.int64) for x in zip(*cases, strict=True))
    m = np.array([len(t) for t in index.text], dtype=np.int64)[window]
    width = 2 * (index.edits[window] + 1)
    rows, columns = int(m.max()), int(width.max())
    text = np.full((len(cases), rows + columns), 256, dtype=np.int16)
    pattern = np.full((len(cases), rows), 257, dtype=np.int16)
    for k in range(len(cases)):
        lo = max(0, int(diagonal[k]))
        part = np.frombuffer(docs[doc[k]], dtype=np.uint8)[lo : int(diagonal[k]) + rows + columns]
        text[k, lo - diagonal[k] : lo - diagonal[k] + len(part)] = part
        pattern[k, : m[k]] = np.frombuffer(index.text[window[k]], dtype=np.uint8)
    column = np.arange(columns)
    cost = np.where(column < width[:, None], diagonal[:, None] + column + (1 << 16), _NEVER)
    edge = np.full((len(cases), 1), _NEVER)
    best = np.full(len(cases), _NEVER)
    end = np.zeros(len(cases), dtype=np.int64)
    for p in range(rows):
        change = np.where(text[:, p : p + columns] == pattern[:, p : p + 1], 0, _EDIT)
        cost = np.minimum(cost + change, np.concatenate([cost[:, 1:], edge], axis=1) + _EDIT)
        cost = np.minimum.accumulate(cost - column * _EDIT, axis=1) + column * _EDIT
        done = np.flatnonzero(m == p + 1)
        if len(done):
            inside = np.where(column < width[done, None], cost[done], _NEVER)
            last = inside.argmin(axis=1)
            best[done] = inside[np.arange(len(done)), last]
            end[done] = diagonal[done] + last + p + 1
    start = (best & (_EDIT - 1)) - (1 << 16)
    return list(zip((best >> 32).tolist(), np.maximum(start, 0).tolist(), end.tolist(), strict=True))


def _offsets(text: str) -> np.ndarray:
    """For each byte of the normal form, the code point of the text that it is from; a space is from the first
    of the white space it stands for. One array, made once for all findings of a text."""
    words = [w.span() for w in _WORD.finditer(text)]
    if text.isascii():
        sizes = None
    else:
        sizes = np.fromiter((len(c.lower().encode("utf-8", "replace")) for c in text), dtype=np.int64, count=len(text))
    parts = []
    for a, b in words:
        own = np.arange(a, b)
        parts += [own if sizes is None else np.repeat(own, sizes[a:b]), np.array([b])]
    return np.concatenate(parts[:-1]) if parts else np.empty(0, dtype=np.int64)


def _bounded(data: bytes, start: int, end: int) -> bool:
    """Does a region begin and end at a border of words?"""
    word = lambda at: 0 <= at < len(data) and (data[at] > 127 or chr(data[at]).isalnum())
    return not (word(start - 1) and word(start)) and not (word(end - 1) and word(end))


def _tiny(tiny: dict[bytes, list[int | None]], data: bytes) -> Iterator[tuple[int | None, int, int]]:
    """Where passages of up to ``SHORT_Q`` - 1 bytes stand as they are, on borders of words."""
    for m in sorted({len(p) for p in tiny}):
        for at in range(len(data) - m + 1):
            items = tiny.get(data[at : at + m])
            if items and _bounded(data, at, at + m):
                for item in items:
                    yield item, at, at + m


def _search(block: Block, texts: list[str | None]) -> list[list[dict]]:
    """Findings per text: the best region per item and place."""
    docs = [normal(t) if t else b"" for t in texts]
    best: dict[tuple[int, int | None, int], tuple[int, int, int]] = {}
    for index in block.indexes:
        cases = []
        for k, data in enumerate(docs):
            for w, d in zip(*(x.tolist() for x in bands(index, data)), strict=True):
                cases.append((k, w, d))
        for at in range(0, len(cases), 2000):
            some = cases[at : at + 2000]
            for (k, w, _), (edits, start, end) in zip(some, verify(index, docs, some), strict=True):
                if edits <= index.edits[w] and (index.edits[w] or _bounded(docs[k], start, end)):
                    key = (k, index.item[w], end)
                    best[key] = min(best.get(key, (edits, start, end)), (edits, start, end))
    if block.tiny:
        for k, data in enumerate(docs):
            best |= {(k, item, end): (0, start, end) for item, start, end in _tiny(block.tiny, data)}
    found: list[list[dict]] = [[] for _ in texts]
    offsets: dict[int, np.ndarray] = {}
    for (k, item, _), (edits, start, end) in sorted(best.items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1] or 0, x[0][2])):
        if k not in offsets:
            offsets = {k: _offsets(texts[k])}
        at = offsets[k]
        a, b = at[min(start, len(at) - 1)], at[min(end, len(at)) - 1] + 1
        found[k].append({"item_id": item, "start": int(a), "end": int(b), "edits": edits})
    return found


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: id, contaminated, item_ids (distinct, sorted, a null id last) and spans
    (item_id, start, end in code points, edits).

    A document is contaminated if a region of it is within ``RATE`` edits per byte of a stretch of ``STRETCH``
    bytes of a passage, or of all of a shorter one, down to a single byte. Where that leaves no edits (under
    10 bytes), the region must stand on borders of words. Case and kinds of white space do not count.

    A benchmark of up to ``block_bytes`` is searched for in one pass; of a larger one each block takes a pass of
    its own over the documents, which keeps only findings, so a task holds one block at a time. Documents are
    not shuffled. Null and empty texts are clean; null passages and those of white space alone are searched
    for nowhere; repeated passages are reported under each id, null included. Texts are searched whole; null
    and repeated ids are kept.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t"))
    items = items.where("t IS NOT NULL").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    if blocks == 1:
        found = _pass(rows, "_id", items.collect()).withColumnRenamed("_id", id_col)
    else:
        rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "documents")
        passes = []
        for k in range(blocks):
            part = items.where(F.expr(f"pmod(xxhash64(i, t), {blocks})") == k).collect()
            passes.append(stored(_pass(rows, "_row", part).where("size(spans) > 0"), "findings"))
        spans = reduce(DataFrame.unionByName, passes).groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        found = rows.select(F.col("_id").alias(id_col), "_row").join(spans, "_row", "left")
        found = found.select(id_col, F.coalesce("spans", F.array().cast(T.ArrayType(_SPAN))).alias("spans"))
    return found.select(
        id_col,
        F.expr("size(spans) > 0 AS contaminated"),
        F.expr("array_sort(array_distinct(spans.item_id)) AS item_ids"),
        F.expr("array_sort(spans) AS spans"),
    )


def _pass(rows: DataFrame, key: str, items: list) -> DataFrame:
    """Findings of one block in every row: its key and spans. The block is bounded by its size in bytes."""
    items = sorted(((r.i, r.t) for r in items), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    block = rows.sparkSession.sparkContext.broadcast(build(items))
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = _search(block.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, arrow)], names=[key, "spans"])

    out = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("spans", T.ArrayType(_SPAN))])
    return rows.select(key, "_text").mapInArrow(run, out)
