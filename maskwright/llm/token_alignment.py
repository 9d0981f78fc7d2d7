"""Alignment of two tokenizers' tokens by merging their end offsets, divided along merge-path diagonals.

The byte offsets at which the tokens of A end and those at which B's end are two sorted lists over the same
bytes. Their merge is a path through the grid of both; diagonal d meets it after d steps, and a binary
search on the diagonal finds where. So the merge is cut into pieces of equally many steps that need nothing
of each other. A piece emits its overlaps (each different end closes one link of an A and a B token) and its
common ends; a group that goes on over a border is stitched by counting the common ends before it.

Counts of id pairs over the corpus: each task keeps a dictionary of the pairs of a block of texts, so a
pair is one row per block, however often it stands there; the totals go back to the blocks the same way.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.storage import stored

#: Steps of the merge in a piece.
WORK = 1 << 16
#: Text that is tokenized and merged at once, and text and different pairs after which a block is closed.
SLICE_BYTES = 2 << 20
BLOCK_BYTES = 32 << 20
BLOCK_PAIRS = 1 << 20
#: How the byte-level tokenizer cuts a text before it merges bytes.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass
class Tokenizers:
    encode_a: object
    encode_b: object
    bytes_a: list[bytes]
    bytes_b: list[bytes]
    length_a: np.ndarray
    length_b: np.ndarray
    names_a: np.ndarray  # id and sign behind it, by id and by place in its group
    names_b: np.ndarray


def _byte_of() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others in
    order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def _names(size: int, width: int, inner: str, last: str) -> np.ndarray:
    return np.array([f"{i}{inner}" for i in range(size)] + [f"{i}{last}" for i in range(size)], dtype=f"S{width}")


@lru_cache(maxsize=1)
def load(byte_path: str, piece_path: str) -> Tokenizers:
    """Both tokenizers; once in a Python worker."""
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    with open(byte_path, encoding="utf-8") as file:
        told = json.load(file)
    special = {t["content"] for t in told.get("added_tokens", [])}
    of = _byte_of()
    vocabulary = {bytes(of[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks=vocabulary, special_tokens={})
    bytes_a = [b""] * (max(vocabulary.values()) + 1)
    for data, i in vocabulary.items():
        bytes_a[i] = data
    slow: list = []

    def encode_a(text: str) -> list[int]:
        try:
            return fast.encode_ordinary(text)
        except BaseException as error:  # its matcher gives up on some very long runs with an error of its own kind
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if not slow:
                slow.append(Tokenizer.from_file(byte_path))
                slow[0].encode_special_tokens = True
            return slow[0].encode(text, add_special_tokens=False).ids

    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    bytes_b = []
    for i in range(pieces.get_piece_size()):
        name = pieces.id_to_piece(i)
        bytes_b.append(bytes([int(name[3:5], 16)]) if pieces.is_byte(i) else name.replace("▁", " ").encode())
    width = len(str(max(len(bytes_a), len(bytes_b)))) + 1
    return Tokenizers(
        encode_a,
        lambda text: pieces.encode(text, num_threads=1),
        bytes_a,
        bytes_b,
        np.array([len(x) for x in bytes_a], dtype=np.int64),
        np.array([len(x) for x in bytes_b], dtype=np.int64),
        _names(len(bytes_a), width, ",", "|"),
        _names(len(bytes_b), width, ",", ";"),
    )


def diagonals(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the first ``at`` ends of the merge are from ``a`` (of equal ends, ``a``'s comes first): a
    binary search along each diagonal, over all diagonals at once."""
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) // 2
        # a[middle] belongs to the first ``at`` if it is not above b[at - middle - 1]
        taken = open_ & (a[np.minimum(middle, len(a) - 1)] <= b[np.clip(at - middle - 1, 0, len(b) - 1)])
        low = np.where(taken, middle + 1, low)
        high = np.where(open_ & ~taken, middle, high)


@dataclass
class Merge:
    link_a: np.ndarray  # token of A and of B of each link, in order
    link_b: np.ndarray
    group_a: np.ndarray  # group of each token
    group_b: np.ndarray
    common: np.ndarray  # tokens of A that end where one of B ends


def merge(a: np.ndarray, b: np.ndarray, *, work: int = WORK) -> Merge:
    """Links and groups of two lists of token ends, both rising and with the same last end."""
    cuts = np.unique(np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b)))
    of_a = diagonals(a, b, cuts) if len(a) and len(b) else np.zeros(len(cuts), dtype=np.int64)
    of_b = cuts - of_a
    links, groups_a, groups_b, ended = [], [], [], []
    before = 0  # common ends of A in the pieces before
    for k in range(len(cuts) - 1):
        (i, i2), (j, j2) = of_a[k : k + 2].tolist(), of_b[k : k + 2].tolist()
        own_a, own_b = a[i:i2], b[j:j2]
        to_b = j + np.searchsorted(own_b, own_a, "left")  # the token of B in which each own token of A ends
        to_a = i + np.searchsorted(own_a, own_b, "right")
        # ends in common: B's may be the first of the next piece, A's the last of the one before
        both_a = b[np.minimum(to_b, len(b) - 1)] == own_a
        both_b = (to_a > 0) & (a[np.maximum(to_a, 1) - 1] == own_b)
        place_a = np.arange(len(own_a)) + (to_b - j)
        place_b = np.arange(len(own_b)) + (to_a - i)
        link = np.empty((len(own_a) + len(own_b), 2), dtype=np.int64)
        link[place_a, 0], link[place_a, 1] = np.arange(i, i2), to_b
        link[place_b, 0], link[place_b, 1] = to_a, np.arange(j, j2)
        keep = np.ones(len(link), dtype=bool)
        keep[place_b[both_b]] = False
        links.append(link[keep])
        closed = np.cumsum(both_a)
        groups_a.append(before + closed - both_a)
        # of a token of B: common ends among the tokens of A that end before it does
        passed = np.append(0, closed)[np.minimum(to_a - i, len(own_a))]
        groups_b.append(before + passed - np.where(both_b, 1, 0))
        ended.append(np.arange(i, i2)[both_a])
        before += int(closed[-1]) if len(closed) else 0
    if not links:
        none = np.empty(0, dtype=np.int64)
        return Merge(none, none, none, none, none)
    link = np.concatenate(links)
    return Merge(link[:, 0], link[:, 1], np.concatenate(groups_a), np.concatenate(groups_b), np.concatenate(ended))


def _pack(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Rising pair codes and how often each stands, byte by byte of their steps, compressed."""
    steps = np.diff(pairs, prepend=np.int64(0)).astype("<i8")
    planes = [steps.view(np.uint8).reshape(-1, 8).T.tobytes(), times.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()]
    return zlib.compress(b"".join(planes), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(data), dtype=np.uint8)
    n = len(raw) // 12
    steps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<i8").ravel()
    return np.cumsum(steps), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _counted(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs, times = pairs[order], times[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first], np.add.reduceat(times, first) if len(first) else times


def aligned(use: Tokenizers, texts: list[str | None]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray] | None]:
    """Per text: tokens of A and B, groups, links, hash of the groups, different pairs and their times; None where
    there are no tokens."""
    ids_a, ids_b, which = [], [], []
    for k, text in enumerate(texts):
        if not text:
            continue
        raw = b" " + text.encode("utf-8", "replace")
        a, b = use.encode_a(" " + text), use.encode_b(text)
        if b"".join(map(use.bytes_a.__getitem__, a)) == raw == b"".join(map(use.bytes_b.__getitem__, b)):
            ids_a.append(np.array(a, dtype=np.int64))
            ids_b.append(np.array(b, dtype=np.int64))
            which.append(k)
    out: list = [None] * len(texts)
    if not which:
        return out
    # one merge over all texts: where a text ends, tokens of both end
    of_a, of_b = np.concatenate(ids_a), np.concatenate(ids_b)
    found = merge(np.cumsum(use.length_a[of_a]), np.cumsum(use.length_b[of_b]))
    to_a, to_b = np.cumsum([len(x) for x in ids_a]), np.cumsum([len(x) for x in ids_b])
    last_a = np.append(np.diff(found.group_a) != 0, True)
    last_b = np.append(np.diff(found.group_b) != 0, True)
    in_a, in_b = np.cumsum(np.bincount(found.group_a)), np.cumsum(np.bincount(found.group_b))
    line = np.empty(len(of_a) + len(of_b), dtype=use.names_a.dtype)
    line[np.arange(len(of_a)) + np.append(0, in_b)[found.group_a]] = use.names_a[of_a + last_a * len(use.bytes_a)]
    line[np.arange(len(of_b)) + in_a[found.group_b]] = use.names_b[of_b + last_b * len(use.bytes_b)]
    link_to = np.searchsorted(found.link_a, to_a, "left")
    group_to = found.group_a[to_a - 1] + 1
    pairs = of_a[found.link_a] * len(use.bytes_b) + of_b[found.link_b]
    line_to, past = to_a + to_b, (0, 0, 0, 0, 0)
    for k, *now in zip(which, to_a.tolist(), to_b.tolist(), link_to.tolist(), group_to.tolist(), line_to.tolist(), strict=True):
        a, b, links, groups, end = now
        text = line[past[4] : end].tobytes().replace(b"\0", b"")[:-1]
        own, times = np.unique(pairs[past[2] : links], return_counts=True)
        out[k] = (a - past[0], b - past[1], groups - past[3], links - past[2], hashlib.sha256(text).hexdigest(), own, times)
        past = tuple(now)
    return out


def _slices(column: pa.Array, size: int) -> Iterator[tuple[int, list[str | None]]]:
    """First row and texts of parts of a batch with about ``size`` of text."""
    texts = column.to_pylist()
    begin, used = 0, 0
    for k, text in enumerate(texts):
        used += len(text or "")
        if used >= size or k == len(texts) - 1:
            yield begin, texts[begin : k + 1]
            begin, used = k + 1, 0


def _per_text(docs: DataFrame, id_col: str, text_col: str, byte_path: str, piece_path: str, slice_bytes: int, block_bytes: int) -> DataFrame:
    """A row per text with its pairs, and a row per block with all pairs of its texts and their times."""
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("is_text", T.BooleanType()),
            T.StructField(id_col, docs.schema[id_col].dataType),
            *[T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")],
            T.StructField("groups_sha256", T.StringType()),
            T.StructField("pairs", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = load(byte_path, piece_path)
        task, number = TaskContext.get().partitionId(), 0
        known, fresh, fresh_pairs, used = (np.empty(0, dtype=np.int64),) * 2, [], 0, 0
        id_type = None

        def settle() -> None:
            nonlocal known, fresh, fresh_pairs
            if fresh:
                parts = [known, *fresh]
                known = _counted(np.concatenate([p for p, _ in parts]), np.concatenate([t for _, t in parts]))
                fresh, fresh_pairs = [], 0

        def row(rows: list[tuple], ids: pa.Array) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows, strict=True)]
            numbers = [pa.array(c, pa.int64()) for c in columns[2:6]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_()), ids, *numbers,
                    pa.array(columns[6], pa.string()), pa.array(columns[7], pa.binary()),
                ],
                names=schema.names,
            )

        def close() -> pa.RecordBatch:
            nonlocal known, number, used
            settle()
            out = row([(block, False, None, None, None, None, None, _pack(*known))], pa.nulls(1, id_type))
            known, used = (np.empty(0, dtype=np.int64),) * 2, 0
            number += 1
            return out

        for batch in batches:
            id_type = batch.column(0).type
            for begin, texts in _slices(batch.column(1), slice_bytes):
                block = (task << 32) + number
                rows = []
                for text, got in zip(texts, aligned(use, texts), strict=True):
                    used += len(text or "")
                    if got is None:
                        rows.append((block, True, 0, 0, 0, 0, "", None))
                        continue
                    *numbers, pairs, times = got
                    fresh.append((pairs, times))
                    fresh_pairs += len(pairs)
                    rows.append((block, True, *numbers, _pack(pairs, times)))
                yield row(rows, batch.column(0).slice(begin, len(texts)))
                if fresh_pairs >= 2 * BLOCK_PAIRS:
                    settle()
                if used >= block_bytes or len(known[0]) >= BLOCK_PAIRS:
                    yield close()
        if used:
            block = (task << 32) + number
            yield close()

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _exploded(blocks: DataFrame) -> DataFrame:
    """A row per block and pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pairs, times = _unpack(data)
                for at in range(0, len(pairs), 1 << 16):
                    part, own = pairs[at : at + (1 << 16)], times[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), block)), pa.array(part), pa.array(own)], names=["block", "pair", "times"]
                    )

    return blocks.mapInArrow(run, "block long, pair long, times long")


def align(
    docs: DataFrame,
    *,
    byte_path: str,
    piece_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    slice_bytes: int = SLICE_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is the byte-level tokenizer at ``byte_path``, B the one of pieces at ``piece_path``; both paths must be there
    on every executor. Null and empty texts, and those that a tokenizer does not give back byte for byte, have
    no tokens: zeros and an empty hash, and count for no pair. Repeated texts count each time; null and repeated
    ids are kept; other columns are not read. Texts are tokenized whole, however long.
    """
    out = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType)]
        + [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
        + [T.StructField("groups_sha256", T.StringType())]
    )
    found = stored(_per_text(docs, id_col, text_col, byte_path, piece_path, slice_bytes, block_bytes), "aligned")
    size_b = len(load(byte_path, piece_path).bytes_b)
    pairs = stored(_exploded(found.where("NOT is_text").select("block", "pairs")), "pairs")
    counts = pairs.groupBy("pair").agg(F.sum("times").alias("count"))
    counts = stored(counts.withColumn("b", F.expr(f"pair % {size_b}")), "counts")
    # one row per id of B: at most the size of its vocabulary
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    counted = counts.join(F.broadcast(most), "b").select("pair", "count", F.expr("count = most AS best"))
    known = pairs.select("block", "pair").join(counted, "pair")
    texts = found.where("is_text").drop("is_text")

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        code = known.column("pair").to_numpy()
        order = np.argsort(code)
        code, count = code[order], known.column("count").to_numpy()[order]
        best = known.column("best").to_numpy(zero_copy_only=False)[order]
        n_best, total = [], []
        for data in texts.column("pairs").to_pylist():
            if data is None:
                n_best.append(0)
                total.append(0)
                continue
            own, times = _unpack(data)
            at = np.searchsorted(code, own)
            n_best.append(int(times @ best[at].astype(np.int64)))
            total.append(int(times @ count[at]))
        columns = {n: texts.column(n) for n in texts.column_names}
        columns |= {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        return pa.table([columns[n] for n in out.names], names=out.names)

    return texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, out)
