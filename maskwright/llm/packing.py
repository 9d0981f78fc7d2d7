"""Packing token sequences by first-fit decreasing.

Documents become token ids, cut into pieces of at most one sequence. Pieces are dealt into randomised
groups; in each group, first-fit decreasing places them with a tournament tree of bin capacities,
which finds the first bin with room in logarithmic time. Only lengths go to the groups.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 2048
END = 1
#: Expected pieces of a group.
GROUP = 20_000
# Entries of a task's word cache; once half of them are new or were asked for again, the others are forgotten.
CACHE = 400_000
# Longer words are not kept, so that the cache stays small with texts that have no spaces.
LONGEST = 64
# Bytes of text cut into words at once; a longer text goes alone.
CHUNK = 1 << 22
# Words that go through the tokenizer in one call.
CALL = 2000

# Kinds of bytes: a word ends where the kind changes; white space is in no word, a byte of kind ALONE is one.
_SPACE, _LETTER, _SIGN, _ALONE = range(4)
_WHITE = b" \n\t\r"
# Texts in these Latin-1 characters, whose letters every library lower-cases alike: words of letters,
# digits one by one, and runs of other ASCII signs; not the apostrophe, which the tokenizer takes with letters.
_LETTERS = re.sub(rb"[^A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]", b"", bytes(range(256)))
_SIGNS = re.sub(rb"[^!-&(-/:-@\[-`{-~]", b"", bytes(range(256)))
_DIGITS = b"0123456789"
_PLAIN = _WHITE + _LETTERS + _SIGNS + _DIGITS
_LOWER = bytes(range(256)).decode("latin-1").lower().encode("latin-1")


def _kinds(of: dict[int, bytes], other: int) -> bytes:
    kinds = bytearray([other] * 256)
    for kind, some in of.items():
        for c in some:
            kinds[c] = kind
    return bytes(kinds)


_SIMPLE_WORDS = _kinds({_SPACE: _WHITE, _LETTER: _LETTERS, _ALONE: _DIGITS}, other=_SIGN)
_PARTS = _kinds({_SPACE: _WHITE}, other=_LETTER)


def _plain(text: str) -> bytes | None:
    """A text in simple letters as lower-case Latin-1; None for others."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if data.translate(None, _PLAIN) or b"<|" in data else data.translate(_LOWER)


def _cut(texts: list[bytes], kinds: bytes) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts in order, and how many there are up to the end of each text."""
    data = b"\n".join([b"", *texts, b""])
    kind = np.frombuffer(data.translate(kinds), dtype=np.uint8)
    inside = kind != _SPACE
    change = kind[1:] != kind[:-1]
    change |= kind[1:] == _ALONE
    start, end = np.flatnonzero(change & inside[1:]), np.flatnonzero(change & inside[:-1])
    upto = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
    offsets = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(end - start, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data.translate(None, _WHITE))]
    return pa.Array.from_buffers(pa.large_binary(), len(start), buffers).dictionary_encode(), upto


class Words:
    """Token ids of texts word by word; only words that are not in the cache go to ``learn``."""

    def __init__(self, kinds: bytes, learn: Callable[[list[bytes]], list[bytes]]):
        self.kinds, self.learn = kinds, learn
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def look_up(self, words: list[bytes]) -> list[bytes]:
        found = list(map(self.recent.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        for k in missing:
            found[k] = self.older.get(words[k])
        new = [k for k in missing if found[k] is None]
        for k, ids in zip(new, self.learn([words[k] for k in new]), strict=True):
            found[k] = ids
        self.recent.update((words[k], found[k]) for k in missing if len(words[k]) <= LONGEST)
        if len(self.recent) > CACHE // 2:
            self.older, self.recent = self.recent, {}
        return found

    def ids(self, texts: list[bytes]) -> list[bytes]:
        words, upto = _cut(texts, self.kinds)
        if not len(words):  # texts without a word, or no texts
            return [b""] * len(texts)
        ids = pa.array(self.look_up(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[upto].tolist()
        view = memoryview(data or b"")
        return [bytes(view[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def numbered(self, rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        return zip([k for k, _ in rows], self.ids([text for _, text in rows]), strict=True)


class Tokens:
    """Token ids of texts by a tokenizer file of the ``word_bpe`` kind (words end in ``</w>``).

    White space never joins or changes words there, so ids are kept per word: a text in simple letters
    is cut into words by the same rule as the tokenizer's, and only new words go through it, many at
    once, set apart by spaces; a word ends at a token with an end mark. Other texts are cut at white
    space only. Many texts are cut and looked up at once, each of their words one time.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.simple = Words(_SIMPLE_WORDS, self._learn_simple)
        self.parts = Words(_PARTS, lambda words: self._learn([w.decode() for w in words]))

    def _learn_simple(self, words: list[bytes]) -> list[bytes]:
        out = []
        for at in range(0, len(words), CALL):
            some = words[at : at + CALL]
            text = b" ".join(some).decode("latin-1")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            last = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(last) != len(some) or last[-1] != 4 * len(ids):
                out += self._learn([w.decode("latin-1") for w in some])
                continue
            data, last = ids.tobytes(), last.tolist()
            out += [data[a:b] for a, b in zip([0, *last[:-1]], last, strict=True)]
        return out

    def _learn(self, words: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(words), CALL):
            encoded = self.tokenizer.encode_batch_fast(words[at : at + CALL], add_special_tokens=False)
            out += [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]
        return out

    def ids(self, texts: Iterable[str | None]) -> Iterator[tuple[int, bytes]]:
        """The place of each text and its ids, as little-endian unsigned 32-bit numbers; in any order."""
        waiting: dict[Words, list[tuple[int, bytes]]] = {self.simple: [], self.parts: []}
        size = {self.simple: 0, self.parts: 0}
        for k, text in enumerate(texts):
            data = _plain(text or "")
            words, data = (self.parts, text.encode()) if data is None else (self.simple, data)
            if waiting[words] and size[words] + len(data) > CHUNK:
                yield from words.numbered(waiting[words])
                waiting[words], size[words] = [], 0
            waiting[words].append((k, data))
            size[words] += len(data)
        for words, rows in waiting.items():
            yield from words.numbered(rows)


_READY: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """One per worker process, kept between its tasks."""
    if path not in _READY:
        _READY[path] = Tokens(path)
    return _READY[path]


def pieces(
    docs: DataFrame,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    with_ids: bool = True,
) -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens and, if asked for, ids): the pieces of each document.

    A document is its ids and ``end``, cut every ``capacity`` ids from its start. A null or empty text
    is one piece that holds ``end`` alone. Null and repeated ids give their own pieces. The tokenizer
    file at ``path`` must be readable where tasks run.
    """
    fields = [
        T.StructField(id_col, docs.schema[id_col].dataType),
        *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        for batch in batches:
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for k, data in tokens.ids(text.as_py() for text in batch.column(1)):
                data += tail
                for at in range(0, len(data), 4 * capacity):
                    part = data[at : at + 4 * capacity]
                    row.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(data) // 4)
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            if row:
                columns = [batch.column(0).take(pa.array(row))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        pa.default_memory_pool().release_unused()  # the worker waits for its next task

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


class Tournament:
    """First-fit search: a complete binary tree whose inner nodes hold the larger capacity below."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """Put an item into the first bin with room: the bin and the room it had."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < length:
                node += 1
        room = tree[node]
        tree[node] = room - length
        place = node - self.leaves
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
        return place, room


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) per item; the items come in decreasing length and each must fit a bin."""
    full = 0
    while full < len(lengths) and lengths[full] >= capacity:
        full += 1
    placed = [(k, 0) for k in range(full)]
    if full < len(lengths):
        tree = Tournament(len(lengths) - full, capacity)
        for n in lengths[full:]:
            where, room = tree.place(n)
            placed.append((full + where, capacity - room))
    return placed


def pack(parts: DataFrame, *, id_col: str = "doc_id", capacity: int = CAPACITY, group: int = GROUP, seed: int = 7) -> DataFrame:
    """``parts`` with sequence_id and offset: the sequence of each piece, and its place there.

    The number of groups follows from the number of pieces; a piece is dealt by a hash of its id,
    start and content. Pieces that are equal in all columns travel as one row with their number, at most half
    a group of them in one row, so however often a row is repeated no group grows. Pieces are placed by
    decreasing length, then by id, start and content, nulls first, so repeated rows change places only among
    themselves. Sequence ids are unique, not dense. An ``ids`` column is carried along; without it only
    numbers are shuffled.
    """
    names = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    parts = parts.select(*names)
    copies = parts.groupBy(*names).agg(F.count("*").alias("_copies"))
    n = parts.count()
    groups = max(1, -(-n // group))
    most = max(1, group // 2)
    dealt = copies.select(
        *names, "_copies", F.explode(F.expr(f"sequence(0L, (_copies - 1) div {most})")).alias("_lot")
    ).select(
        *names,
        F.expr(f"least(_copies - _lot * {most}, {most})").alias("_copies"),
        F.expr(f"pmod(xxhash64({id_col}, start, ids_crc32, _lot, {seed}), {groups})").alias("_group"),
    )
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        base = int(frame["_group"].iloc[0]) << 32
        frame = frame.loc[frame.index.repeat(frame["_copies"])].drop(columns=["_group", "_copies"])
        frame = frame.sort_values(["length", id_col, "start", "ids_crc32"], ascending=[False, True, True, True], na_position="first")
        placed = first_fit_decreasing(frame["length"].tolist(), capacity)
        frame["sequence_id"] = [base + b for b, _ in placed]
        frame["offset"] = [o for _, o in placed]
        return frame

    return dealt.groupBy("_group").applyInPandas(place, schema)


def sequences(packed: DataFrame, *, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens): the token ids of every sequence, in order of offset.

    Filled up with ``pad`` to ``capacity``, except where the number of tokens is a power of two.
    """
    rows = packed.groupBy("sequence_id").agg(
        F.expr("flatten(transform(array_sort(collect_list(struct(offset, ids))), x -> x.ids)) AS ids"),
        F.sum("length").alias("n_tokens"),
    )
    width = f"CASE WHEN bit_count(n_tokens) = 1 THEN n_tokens ELSE {capacity} END"
    return rows.withColumn("ids", F.expr(f"concat(ids, array_repeat({pad}, cast({width} - n_tokens AS int)))"))
