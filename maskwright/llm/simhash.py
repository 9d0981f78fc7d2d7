"""Near-duplicate documents by SimHash and pivot distance tables.

Documents with equal fingerprints are one class. Each class gets a table row once: its Hamming distances
to many reference fingerprints. Classes that may be within the limit meet under block keys and bring their
rows along; pairs are discarded by these (the distance of two fingerprints is at least the largest
difference of their table rows), and the survivors are verified. Of a group of classes only a spanning forest of its links leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.batches import map_texts
from maskwright.llm.components import components
from maskwright.llm.storage import stored

WORDS = 4
SEED = 42
LIMIT = 4
# 64 bits in six blocks: of 4 or fewer differing bits, at least two blocks have none.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
PAIRS = list(combinations(range(len(BLOCKS)), 2))
#: Reference fingerprints, from a fixed seed.
PIVOTS = np.random.default_rng(64).integers(0, 2**64, 24, dtype=np.uint64)
#: Groups above this many classes are dealt out as pairs of parts.
GROUP = 20_000
_UPPER_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash over the hashes of all word shingles, repeats included; 0 without words."""
    found = (text or "").encode("utf-8", "replace").translate(_UPPER_TO_LOWER).split()
    if not found:
        return 0
    n = len(found)
    if n <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    else:
        joined = b" ".join(found)
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
        hashes = [digest(joined[a:b], SEED) for a, b in spans]
    values = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), 1 << 14):
        part = values[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id, fp (the fingerprint as a signed long) per row. Null and empty texts have 0."""

    def work(texts: list[str | None]) -> list:
        return [np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)]

    return map_texts(docs, id_col, text_col, [T.StructField("fp", T.LongType())], work)


def pivot_table(classes: DataFrame) -> DataFrame:
    """Adds ``distances``: the Hamming distance of ``fp`` to each reference fingerprint, a byte each."""
    signed = PIVOTS.view(np.int64).tolist()
    cells = ", ".join(f"lpad(hex(bit_count(fp ^ {f'{p}L' if p >= 0 else f'(-{-p}L)'})), 2, '0')" for p in signed)
    return classes.withColumn("distances", F.expr(f"unhex(concat({cells}))"))


def _forest(values: np.ndarray, table: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links that connect all distinct fingerprints of a group as the links within ``limit`` do.

    ``table`` holds their pivot distances; it is sorted by the first one.
    A search starts from a fingerprint, takes all that are not reached yet and within the limit, and
    goes on from these; a reached one is never compared again. Candidates lie in a window of the
    first distance, must differ by at most ``limit`` in every other one, and are then verified.
    """
    order = np.argsort(table[:, 0], kind="stable")
    values, table = values[order], table[order]
    left = np.arange(len(values))
    links = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            first = table[left, 0]
            window = slice(*np.searchsorted(first, [table[x, 0] - limit, table[x, 0] + limit + 1]))
            near = left[window]
            for k in range(1, len(PIVOTS)):
                if len(near) < 16:
                    break
                near = near[np.abs(table[near, k] - table[x, k]) <= limit]
            near = near[np.abs(table[near] - table[x]).max(axis=1, initial=0) <= limit]
            near = near[np.bitwise_count(values[near] ^ values[x]) <= limit]
            if len(near):
                links += [(int(values[x]), int(values[y])) for y in near]
                queue += near.tolist()
                left = left[~np.isin(left, near, assume_unique=True)]
    return links


def _small(keys: np.ndarray, values: np.ndarray, table: np.ndarray, limit: int, most: int) -> list[tuple[int, int]]:
    """The links of all groups of up to ``most`` members, of sorted keys, in whole arrays."""
    links = []
    for step in range(1, most):
        at = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(at):
            break
        at = at[np.abs(table[at] - table[at + step]).max(axis=1) <= limit]
        at = at[np.bitwise_count(values[at] ^ values[at + step]) <= limit]
        links += zip(values[at].tolist(), values[at + step].tolist(), strict=True)
    return links


def _links(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Links of rows (key, fp, distances) that come sorted by key; a group may go over several batches."""
    few = 32

    def of(keys: np.ndarray, fps: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
        table = table.astype(np.int16)
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(start, len(keys)))
        small = np.repeat((size > 1) & (size <= few), size)
        links = _small(keys[small], fps[small], table[small], limit, few) if small.any() else []
        for a, n in zip(start[size > few], size[size > few], strict=True):
            values, first = np.unique(fps[a : a + n], return_index=True)
            links += _forest(values, table[a + first], limit)
        ends = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        table = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(len(keys), -1)
        rows = (keys, fps.view(np.uint64), table)
        if keys[-1] == keys[0] and (not held or held[-1][0][-1] == keys[0]):
            held.append(rows)
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        held.append(tuple(x[:last] for x in rows))
        yield of(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held = [tuple(x[last:] for x in rows)]
    if held:
        yield of(*(np.concatenate(x) for x in zip(*held, strict=True)))


def links(classes: DataFrame, *, limit: int = LIMIT) -> DataFrame:
    """(a, b): links among distinct fingerprints (column fp, and their ``distances`` of ``pivot_table``, which
    are added where they are missing) that give the same components as all pairs within ``limit`` (at most 4) bits.

    A fingerprint goes under one key per pair of blocks. Keys that only one fingerprint has are
    dropped before the rows are dealt out; a key of more than ``GROUP`` fingerprints is cut into parts
    and each pair of parts compared by itself, so that no task holds an unbounded group.
    """
    if limit > 4:
        raise ValueError("the block keys are complete up to 4 bits")
    if "distances" not in classes.columns:
        classes = pivot_table(classes)
    blocks = [f"(shiftrightunsigned(fp, {at}) & {(1 << size) - 1}L)" for at, size in BLOCKS]
    keys = [f"shiftleft({blocks[i]}, 15) | shiftleft({blocks[j]}, 4) | {k}L" for k, (i, j) in enumerate(PAIRS)]
    rows = classes.select("fp", "distances", F.expr(f"explode(array({', '.join(keys)})) AS key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, "key")
    parts = f"cast(ceil(n / {GROUP}) AS int)"
    mine = f"cast(pmod(xxhash64(fp, 'part'), {parts}) AS int)"
    cells = f"CASE WHEN n <= {GROUP} THEN array(0) ELSE transform(sequence(0, {parts} - 1), p -> least(p, {mine}) * {parts} + greatest(p, {mine})) END"
    rows = rows.select("key", "fp", "distances", F.expr(f"explode({cells}) AS cell"))
    rows = rows.select(F.expr("key + shiftleft(cast(cell AS bigint), 26)").alias("key"), "fp", "distances")
    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda batches: _links(batches, limit), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, limit: int = LIMIT
) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits) and component_id, the smallest id
    reachable over links of at most ``limit`` differing bits, the own id included.

    Null and empty texts have fingerprint zero and are linked like others. Rows with a null id get a
    component like others; a null id is never the smallest unless all of a component are null.
    Repeated ids give a row each. Other columns are not read.
    """
    marked = stored(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    classes = stored(pivot_table(marked.groupBy("fp").agg(F.min(id_col).alias("least"))), "classes")
    found = components(links(classes, limit=limit))
    rooted = classes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    small = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = rooted.join(small, "root").select("fp", "component_id")
    return marked.join(answer, "fp").select(id_col, F.expr("lower(lpad(hex(fp), 16, '0'))").alias("fingerprint"), "component_id")
