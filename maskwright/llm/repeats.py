"""Removal of repeated passages by a run-length index.

A byte goes if it lies in a ``WIDTH``-byte string that also starts in a document with a smaller id.
Every such string has an anchor, the least hash among its ``Q``-byte parts, which depends on the
string alone. So occurrences of a string meet in the bucket of their anchor. In outline:

1. groups of documents send the hashes of their anchors to buckets, which answer, bit by bit, which
   occur in two documents;
2. groups send the strings around such anchors (a segment: all strings with the same anchor, back to
   back) to buckets. A bucket indexes distinct segments in a run-compressed Burrows-Wheeler transform:
   those of an anchor's largest document lend nothing and are left out. It streams distinct segments
   through it: those of an anchor's smallest document alone lose nothing and are left out. Positions whose
   longest match has ``WIDTH`` bytes get the smallest document of their string;
3. groups receive the ranges to remove.

Documents are shuffled once, by group; the three passes over them reuse that exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.run_length_index import RunLengthIndex

WIDTH = 50
Q = 16
PIECE = 1 << 15
#: Text of a group and of a bucket, in bytes.
GROUP_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
#: Text of the segments that share an index in a bucket, in bytes; only a part is indexed, its arrays stay near the processor.
INDEX_BYTES = 1 << 19


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, count, hash) of the segments of documents given back to back: ``count`` consecutive strings
    of ``WIDTH`` bytes from ``start`` on, none across two documents, that have the same anchor."""
    starts, counts, hashes = [], [], []
    span = WIDTH - Q + 1
    raw = data.tobytes()
    begins = np.concatenate([[0], ends[:-1]])
    # first string start of each document and the first that would leave it
    stops = np.maximum(ends - WIDTH + 1, begins)
    for at in range(0, max(0, len(data) - WIDTH + 1), PIECE):
        windows = min(PIECE, len(data) - WIDTH + 1 - at)
        n = windows + span - 1  # anchors' parts
        code = np.empty(n + 8, dtype=np.uint64)
        for s in range(8):
            code[s::8] = np.frombuffer(raw, dtype="<u8", count=(n + 8 - s + 7) // 8, offset=at + s) if at + n + 15 + 8 <= len(raw) else _codes_at_end(raw, at + s, (n + 8 - s + 7) // 8)
        key = code[:n] * np.uint64(0x9E3779B97F4A7C15) + code[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(31)
        key *= np.uint64(0xD6E8FEB86659FD93)
        key &= np.uint64(2**64 - 1 - 0xFFFF)
        key |= np.arange(n, dtype=np.uint64)
        for step in (1, 2, 4, 8, 16):
            key = np.minimum(key[:-step], key[step:])
        key = np.minimum(key[: windows], key[span - 32 : span - 32 + windows])
        change = np.append(True, key[1:] != key[:-1])
        lo, hi = np.searchsorted(stops, at), np.searchsorted(begins, at + windows)
        inside = np.concatenate([stops[lo:hi], begins[lo:hi]]) - at
        change[inside[(inside >= 0) & (inside < windows)]] = True
        first = np.flatnonzero(change)
        starts.append(first + at)
        counts.append(np.diff(np.append(first, windows)))
        hashes.append(key[first] >> np.uint64(16))
    if not starts:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, np.empty(0, dtype=np.uint64)
    start, count, found = np.concatenate(starts), np.concatenate(counts), np.concatenate(hashes)
    good = start + WIDTH <= ends[np.searchsorted(ends, start, side="right")]
    return start[good], count[good], found[good]


def _codes_at_end(raw: bytes, at: int, count: int) -> np.ndarray:
    part = raw[at : at + 8 * count]
    return np.frombuffer(part + bytes(8 * count - len(part)), dtype="<u8")


class _Group:
    """The documents of a group as one array of bytes, with the number of each document."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.ids = table.column("_id")
        key = table.column("_key").to_numpy()
        mark = table.column("_mark").to_numpy()
        text = table.column("_text").combine_chunks() if isinstance(table.column("_text"), pa.ChunkedArray) else table.column("_text")
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.large_string())
        text = text.cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64, count=len(text) + 1, offset=8 * text.offset) if len(text) else np.zeros(1, dtype=np.int64)
        body = text.buffers()[2]
        whole = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.empty(0, dtype=np.uint8)
        self.data = whole[int(offsets[0]) : int(offsets[-1])]
        self.ends = (offsets[1:] - offsets[0]).astype(np.int64)
        pairs = np.empty(len(key), dtype=[("key", np.int64), ("mark", np.int64)])
        pairs["key"], pairs["mark"] = key, mark
        distinct, self.number = np.unique(pairs, return_inverse=True)
        self.keys = distinct["key"]  # by number

    def codes(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, count, code, row): segments, bucket and 32 more bits of their anchor, and their document."""
        start, count, found = anchors(self.data, self.ends)
        n = np.uint64(buckets)
        code = ((found % n) << np.uint64(32)) | ((found // n) & np.uint64(0xFFFFFFFF))
        return start, count, code, np.searchsorted(self.ends, start, side="right")


def _by_bucket(code: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted codes."""
    bucket = (code >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, dtype=np.int64)
    return list(zip(bucket[first].tolist(), first.tolist(), np.append(first[1:], len(bucket)).tolist(), strict=True))


ASK = "bucket int, grp int, hashes binary, several binary"
ANSWER = "grp int, bucket int, repeated binary"
SEGMENTS = "bucket int, grp int, known boolean, docs binary, starts binary, lengths binary, body binary, keys binary, codes binary"
RANGES = "grp int, docs binary, starts binary, ends binary"


def _ask(table: pa.Table, buckets: int) -> pa.Table:
    """The distinct anchor hashes of a group by bucket, and which of them two of its documents have."""
    grp = table.column("_grp")[0].as_py()
    group = _Group(table)
    _, _, code, row = group.codes(buckets)
    key = group.keys[group.number[row]] if len(row) else np.empty(0, dtype=np.int64)
    order = np.argsort(code)
    code, key = code[order], key[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, dtype=np.int64)
    several = np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first) if len(first) else np.empty(0, dtype=bool)
    code = code[first]
    rows = [
        (b, grp, (code[i:j] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), np.packbits(several[i:j]).tobytes())
        for b, i, j in _by_bucket(code)
    ]
    return _table(rows, ["bucket", "grp", "hashes", "several"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])


def _table(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _answer(table: pa.Table) -> pa.Table:
    """Per group that asked: which of its hashes are repeated anywhere."""
    rows = sorted(table.to_pylist(), key=lambda r: r["grp"])
    hashes = [np.frombuffer(r["hashes"], dtype="<u4") for r in rows]
    several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], dtype=np.uint8), count=len(h)) for r, h in zip(rows, hashes, strict=True)])
    flat = np.concatenate(hashes)
    order = np.argsort(flat)
    ranked = flat[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    size = np.diff(np.append(first, len(ranked)))
    yes = (size > 1) | (np.maximum.reduceat(several[order], first) > 0)
    repeated = np.empty(len(flat), dtype=bool)
    repeated[order] = np.repeat(yes, size)
    out, at = [], 0
    for r, h in zip(rows, hashes, strict=True):
        bits = repeated[at : at + len(h)]
        at += len(h)
        if bits.any():
            out.append((r["grp"], r["bucket"], np.packbits(bits).tobytes()))
    return _table(out, ["grp", "bucket", "repeated"], [pa.int32(), pa.int32(), pa.binary()])


def _gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of ranges of ``data``, back to back."""
    at = np.cumsum(length) - length
    return data[np.repeat(start - at, length) + np.arange(int(length.sum()))] if len(start) else data[:0]


def _same(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A number per range, equal where and only where the bytes are equal."""
    if not len(start):
        return np.empty(0, dtype=np.int64)
    width = -(-int(length.max()) // 8) * 8
    number = np.empty(len(start), dtype=np.int64)
    columns = width // 8 + 1
    cells = np.zeros((len(start), columns), dtype=np.uint64)
    for a in range(0, len(start), 1 << 15):
        s, n = start[a : a + (1 << 15)], length[a : a + (1 << 15)]
        at = s[:, None] + np.arange(width)
        block = np.where(np.arange(width) < n[:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
        cells[a : a + len(s), :-1] = block.view(np.uint64)
        cells[a : a + len(s), -1] = n
    mixed = np.zeros(len(start), dtype=np.uint64)
    for k in range(columns):
        mixed = (mixed ^ cells[:, k]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = np.append(False, mixed[order][1:] == mixed[order][:-1])
    if (same[1:] & (cells[order][1:] != cells[order][:-1]).any(axis=1)).any():  # equal hashes, unequal bytes
        order = np.lexsort(cells.T)
        same = np.append(False, (cells[order][1:] == cells[order][:-1]).all(axis=1))
    number[order] = np.cumsum(~same) - 1
    return number


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of documents joined where they touch or overlap."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    shift = doc * (int(end.max()) + 2)
    far = np.maximum.accumulate(end + shift)
    fresh = np.append(True, (start + shift)[1:] > far[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], far[last] - shift[last]


def _segments(table: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """Segments of a group with a repeated anchor, by bucket.

    Of equal segments in the group only those of the smallest document go to the bucket; the others
    are known to be repeats of it, so however often a passage stands in a group, its bucket gets it once.
    """
    names = [f.split()[0] for f in SEGMENTS.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 6]
    if not table.num_rows or not answers.num_rows:
        return _table([], names, kinds)
    grp = table.column("_grp")[0].as_py()
    group = _Group(table)
    start, count, code, row = group.codes(buckets)
    distinct, back = np.unique(code, return_inverse=True)
    repeated = np.zeros(len(distinct), dtype=bool)
    bits = {r["bucket"]: r["repeated"] for r in answers.to_pylist()}
    for b, i, j in _by_bucket(distinct):
        if b in bits:
            repeated[i:j] = np.unpackbits(np.frombuffer(bits[b], dtype=np.uint8), count=j - i)
    use = np.flatnonzero(repeated[back])
    start, length, code, row = start[use], count[use] + WIDTH - 1, code[use], row[use]
    number = group.number[row]
    key = group.keys[number]
    place = start - np.concatenate([[0], group.ends])[row]
    content = _same(group.data, start, length)
    least = np.full(int(content.max()) + 1 if len(content) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, content, key)
    known = key > least[content]
    doc, a, b = _merged(number[known], place[known], place[known] + length[known])
    rows = []
    if len(doc):
        # ranges that need no answer go back by way of some bucket, spread over all
        rows.append((grp % buckets, grp, True, doc.astype("<u4").tobytes(), a.astype("<u4").tobytes(), b.astype("<u4").tobytes(), b"", b"", b""))
    ask = np.flatnonzero(~known)
    ask = ask[np.argsort(code[ask], kind="stable")]
    body = _gather(group.data, start[ask], length[ask]).tobytes()
    edge = np.concatenate([[0], np.cumsum(length[ask])])
    doc, where, size, own = number[ask].astype("<u4"), place[ask].astype("<u4"), length[ask].astype(np.uint8), key[ask].astype("<i8")
    low = (code[ask] & np.uint64(0xFFFFFFFF)).astype("<u4")
    for bucket, i, j in _by_bucket(code[ask]):
        rows.append((bucket, grp, False, doc[i:j].tobytes(), where[i:j].tobytes(), size[i:j].tobytes(), body[edge[i] : edge[j]], own[i:j].tobytes(), low[i:j].tobytes()))
    return _table(rows, names, kinds)


def _repeated(
    data: np.ndarray, at: np.ndarray, length: np.ndarray, key: np.ndarray, code: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, from, to) of the bytes of segments that also stand in a document of a smaller key, as matching
    statistics against the index tell. Equal strings have equal codes of their anchors."""
    content = _same(data, at, length)
    chosen = np.empty(int(content.max()) + 1, dtype=np.int64)
    chosen[content] = np.arange(len(content))
    owner, largest = np.full(len(chosen), np.iinfo(np.int64).max), np.full(len(chosen), np.iinfo(np.int64).min)
    np.minimum.at(owner, content, key)
    np.maximum.at(largest, content, key)
    anchor = np.unique(code[chosen], return_inverse=True)[1]
    least_key, largest_key = (np.full(int(anchor.max()) + 1, v) for v in (np.iinfo(np.int64).max, np.iinfo(np.int64).min))
    np.minimum.at(least_key, anchor, owner)
    np.maximum.at(largest_key, anchor, largest)
    lends, loses = np.flatnonzero(owner < largest_key[anchor]), np.flatnonzero(largest > least_key[anchor])
    if not len(lends):
        return (np.empty(0, dtype=np.int64),) * 3
    size = length[chosen]
    index = RunLengthIndex.build(_gather(data, at[chosen[lends]], size[lends]), size[lends], owner[lends], WIDTH)
    string, place, least = index.stream(_gather(data, at[chosen[loses]], size[loses]), size[loses])
    # smallest document per string of each distinct segment, as rows of a table
    first = np.full((len(chosen), int(size.max()) - WIDTH + 1), np.iinfo(np.int64).max)
    first[loses[string], place] = least
    gone = first[content] < key[:, None]
    edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    segment, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return segment, begin, end + WIDTH - 1


def _ranges(table: pa.Table, index_bytes: int) -> pa.Table:
    """Per group: the ranges to remove. Equal strings have one anchor and so one lot, a part of the anchor's
    hash; as many lots share an index as fill it."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["known"], r["grp"]))
    out = [(r["grp"], r["docs"], r["starts"], r["lengths"]) for r in rows if r["known"]]
    rows = [r for r in rows if not r["known"]]
    if rows:
        get = lambda name, kind: np.concatenate([np.frombuffer(r[name], dtype=kind) for r in rows])
        doc, start, length, key = get("docs", "<u4"), get("starts", "<u4"), get("lengths", np.uint8).astype(np.int64), get("keys", "<i8")
        data = np.frombuffer(b"".join(r["body"] for r in rows), dtype=np.uint8)
        which = np.repeat(np.arange(len(rows)), [len(r["lengths"]) for r in rows])
        at = np.cumsum(length) - length
        indexes = min(256, -(-len(data) // index_bytes))
        code = get("codes", "<u4")
        lot = (code & 0xFF).astype(np.int64) * indexes >> 8
        order = np.argsort(lot, kind="stable")
        cut = np.searchsorted(lot[order], np.arange(indexes + 1))
        found = []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if j > i:
                some = order[i:j]
                r, a, b = _repeated(data, at[some], length[some], key[some], code[some])
                found.append((some[r], a, b))
        r0, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        a, b = start[r0].astype(np.int64) + a, start[r0].astype(np.int64) + b
        order = np.argsort(which[r0], kind="stable")
        cut = np.searchsorted(which[r0][order], np.arange(len(rows) + 1))
        for k, r in enumerate(rows):
            some = order[cut[k] : cut[k + 1]]
            if len(some):
                out.append((r["grp"], doc[r0[some]].astype("<u4").tobytes(), a[some].astype("<u4").tobytes(), b[some].astype("<u4").tobytes()))
    return _table(out, ["grp", "docs", "starts", "ends"], [pa.int32(), pa.binary(), pa.binary(), pa.binary()])


def _cut(table: pa.Table, ranges: pa.Table, with_text: bool) -> pa.Table:
    """What is left of the documents of a group."""
    if not table.num_rows:
        return pa.table([pa.array([], t) for t in (table.schema.field("_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())], names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    group = _Group(table)
    begin = np.concatenate([[0], group.ends[:-1]])
    edge = np.zeros(len(group.data) + 1, dtype=np.int32)
    parts = ranges.to_pylist()
    if parts:
        get = lambda name: np.concatenate([np.frombuffer(r[name], dtype="<u4") for r in parts]).astype(np.int64)
        doc, start, end = _merged(get("docs"), get("starts"), get("ends"))
        # rows that repeat a document have its number too
        by = np.argsort(group.number, kind="stable")
        low, high = np.searchsorted(group.number[by], doc), np.searchsorted(group.number[by], doc, side="right")
        many = high - low
        row = by[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        np.add.at(edge, begin[row] + np.repeat(start, many), 1)
        np.add.at(edge, begin[row] + np.repeat(end, many), -1)
    gone = np.cumsum(edge)[:-1] > 0
    kept, shas, removed, spans = [], [], [], []
    for a, b in zip(begin.tolist(), group.ends.tolist(), strict=True):
        mask = gone[a:b]
        n = int(np.count_nonzero(mask))
        rest = (group.data[a:b][~mask] if n else group.data[a:b]).tobytes()
        removed.append(n)
        spans.append(int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(mask[0]) if n else 0)
        shas.append(hashlib.sha256(rest).hexdigest())
        kept.append(rest if with_text else None)
    ids = group.ids
    return pa.table(
        [ids, pa.array(group.ends - begin), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas), pa.array(kept, pa.binary())],
        names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
    )


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes; null unless
    ``with_text``).

    Ids are integers. A null id keeps null and counts as 2^63 - 1, larger than any other id; rows with equal ids
    do not remove each other's bytes, and equal rows give equal results. A row is dealt to a group by id, text and
    part of the input, so a row that is repeated very often fills no group: copies in one part of the input stay
    together, those of different parts meet in the buckets like any repeats. A null text is empty. Strings are
    compared as bytes, so what is kept may end inside a character. Other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("_key"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
    ).withColumn("_mark", F.xxhash64("_text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    groups, buckets = max(1, -(-total // GROUP_BYTES)), max(8, -(-total // BUCKET_BYTES))
    rows = rows.withColumn("_grp", F.expr(f"cast(pmod(xxhash64(_key, _mark, spark_partition_id(), 'group'), {groups}) AS int)"))
    grouped = rows.groupBy("_grp")
    asked = grouped.applyInArrow(lambda t: _ask(t, buckets), ASK)
    answers = asked.groupBy("bucket").applyInArrow(_answer, ANSWER).withColumnRenamed("grp", "_grp")
    segments = grouped.cogroup(answers.groupBy("_grp")).applyInArrow(lambda t, a: _segments(t, a, buckets), SEGMENTS)
    index_bytes = INDEX_BYTES
    ranges = segments.groupBy("bucket").applyInArrow(lambda t: _ranges(t, index_bytes), RANGES).withColumnRenamed("grp", "_grp")
    fields = "_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    left = grouped.cogroup(ranges.groupBy("_grp")).applyInArrow(lambda t, r: _cut(t, r, with_text), fields)
    return left.select(F.col("_id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
