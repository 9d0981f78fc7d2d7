"""A run-compressed Burrows-Wheeler index over many short strings, with matching statistics.

The transform of the sorted suffixes is kept as runs: first row, byte, the row that the run's first row
leads to one byte to the left (rows of a run lead to consecutive rows), and the places of the suffixes of
its first and last row. Any string is streamed from its end: each step extends the longest match to the
left, or, where the byte before the match is another one, goes on from the nearer end of a run of the
wanted byte, as the places sampled there tell how much of the match is left. So every position of the
string gets the length of its longest match and a row of it. Rows whose suffixes agree in the first
``width`` bytes form an interval, of which the index keeps the smallest owner of a string in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros after the end."""
    n = len(text)
    raw = np.concatenate([text, np.zeros(8, dtype=np.uint8)]).tobytes()
    words = np.empty(n, dtype=np.uint64)
    for s in range(min(8, n)):
        words[s::8] = np.frombuffer(raw, dtype=">u8", count=(n - s + 7) // 8, offset=s)
    return words


def _suffix_order(words: np.ndarray, left: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all strings in order, and the rank of each by its first 32 bytes.

    ``words`` are those of bytes + 1, strings end in 0; ``left`` is how many bytes of its string a suffix has.
    Eight bytes are sorted first, then the sorted length is doubled, for undecided suffixes only.
    Equal suffixes follow their place, that is the order of their strings.
    """
    n = len(words)
    masks = np.array([(2**64 - 1) ^ (2 ** (64 - 8 * k) - 1) for k in range(9)], dtype=np.uint64)
    key = words & masks[np.minimum(left, 8)]
    order = np.argsort(key)
    key = key[order]
    start = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    at_32, h = None, 8
    while True:
        if h == 32:
            at_32 = rank.copy()
        open_ = np.flatnonzero(~start | np.append(~start[1:], False))
        if not len(open_):
            break
        i = order[open_]
        last = h > longest
        second = i if last else np.where(left[i] >= h, rank[np.minimum(i + h, n - 1)] + 1, 0)
        key = (rank[i].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        by = np.argsort(key)
        order[open_], key = i[by], key[by]
        fresh = np.append(True, key[1:] != key[:-1])
        start[open_] = fresh
        rank[order[open_]] = np.maximum.accumulate(np.where(fresh, open_, 0))
        if last:
            break
        h *= 2
    return order, rank if at_32 is None else at_32


class _Starts:
    """Which of some sorted starts a number belongs to: a bit per number and a count per 64 of them."""

    def __init__(self, starts: np.ndarray, size: int):
        bits = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
        bits[starts] = 1
        self.bits = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(counts) - counts - 1

    def of(self, numbers: np.ndarray) -> np.ndarray:
        block = numbers >> 6
        upto = ~np.uint64(0) >> (63 - (numbers & 63)).astype(np.uint64)
        return self.before[block] + np.bitwise_count(self.bits[block] & upto)


@dataclass
class RunLengthIndex:
    runs: _Starts
    run_start: np.ndarray
    run_last: np.ndarray
    run_byte: np.ndarray
    run_leads_to: np.ndarray
    first_place: np.ndarray  # of the suffix of a run's first row
    last_place: np.ndarray
    by_byte: np.ndarray  # runs by byte, then row, and these two as one number
    by_byte_key: np.ndarray
    words: np.ndarray
    intervals: _Starts
    interval_owner: np.ndarray
    width: int

    @classmethod
    def build(cls, data: np.ndarray, lengths: np.ndarray, owners: np.ndarray, width: int) -> RunLengthIndex:
        """Index strings given back to back in ``data``, each of at least ``width`` bytes (32 < width <= 64)."""
        count = len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(int(ends[-1]) + 1, dtype=np.uint8)
        body = np.ones(len(text), dtype=bool)
        body[ends] = False
        text[body] = data + np.uint8(1)  # UTF-8 has no byte 255
        string = np.repeat(np.arange(count), lengths + 1)
        left = ends[string] - np.arange(len(text))
        words = _words(text)
        order, rank = _suffix_order(words, left, int(lengths.max()))
        # intervals of rows with equal first `width` bytes
        rows = np.flatnonzero(left[order] >= width)
        i = order[rows]
        head, tail = rank[i], rank[i + width - 32]
        begins = np.append(True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1]) | (np.diff(rows) > 1))
        owner = np.minimum.reduceat(owners[string[i]], np.flatnonzero(begins))
        # runs of the transform
        before = text[order - 1]
        run_start = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        run_end = np.append(run_start[1:], len(before))
        size, run_byte = run_end - run_start, before[run_start]
        by_byte = np.argsort(run_byte, kind="stable")
        leads_to = np.empty(len(run_start), dtype=np.int64)
        leads_to[by_byte] = np.cumsum(size[by_byte]) - size[by_byte]
        by_byte_key = run_byte[by_byte].astype(np.int64) * len(text) + run_start[by_byte]
        return cls(
            _Starts(run_start, len(text)), run_start, run_end - 1, run_byte, leads_to, order[run_start], order[run_end - 1],
            by_byte, by_byte_key, words, _Starts(rows[begins], len(text)), owner, width,
        )

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes, up to ``most``, are equal from the places ``a`` and ``b`` on."""
        same = np.zeros(len(a), dtype=np.int64)
        open_ = np.flatnonzero(most > 0)
        while len(open_):
            x = self.words[a[open_] + same[open_]] ^ self.words[b[open_] + same[open_]]
            # the bits of x, from its exponent; without the bits after a set one it is not rounded up
            alike = (64 - np.frexp((x & ~(x >> np.uint64(1))).astype(np.float64))[1].astype(np.int64)) >> 3
            same[open_] += alike
            open_ = open_[(alike == 8) & (same[open_] < most[open_])]
        return np.minimum(same, most)

    def _jump(self, byte: np.ndarray, row: np.ndarray, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """(run, row, place, length) of the longest rest of matches that ``byte`` stands before; length -1 if it stands nowhere."""
        after = np.searchsorted(self.by_byte_key, byte.astype(np.int64) * len(self.words) + row)
        best = [np.zeros(len(byte), dtype=np.int64) for _ in range(3)] + [np.full(len(byte), -1)]
        # The last row of the run before; where it leaves less than the whole match, the first of the run after.
        # Beyond either end of the list stands a run of another byte or one farther off, which is no better.
        for at, rows, places in ((after - 1, self.run_last, self.last_place), (after, self.run_start, self.first_place)):
            run = self.by_byte[at % len(self.by_byte)]
            ok = np.flatnonzero((self.run_byte[run] == byte) & (best[3] < length))
            run = run[ok]
            there = places[run]
            rest = self._common(there, place[ok], length[ok])
            better = rest > best[3][ok]
            ok, run = ok[better], run[better]
            for kept, new in zip(best, (run, rows[run], there[better], rest[better]), strict=True):
                kept[ok] = new
        return tuple(best)

    def matches(self, data: np.ndarray, lengths: np.ndarray, least: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
        """Matching statistics of strings given back to back in ``data``, all strings at once, from their ends.

        Yields per step arrays (string, position, length, row): how long the longest match of the rest of the
        string from that position on is, and a row whose suffix begins with it. A string ends early where
        no match of ``least`` bytes can follow any more.
        """
        begin = np.cumsum(lengths) - lengths
        live = np.flatnonzero(lengths > 0)
        at = lengths[live].astype(np.int64)
        row, length = np.zeros(len(live), dtype=np.int64), np.zeros(len(live), dtype=np.int64)
        place = np.full(len(live), self.first_place[0])
        while len(live):
            at = at - 1
            byte = data[begin[live] + at] + np.uint8(1)
            run = self.runs.of(row)
            other = np.flatnonzero(self.run_byte[run] != byte)
            if len(other):
                run[other], row[other], place[other], length[other] = self._jump(byte[other], row[other], place[other], length[other])
            row = self.run_leads_to[run] + row - self.run_start[run]
            place, length = place - 1, length + 1
            nowhere = length == 0
            row[nowhere], place[nowhere] = 0, self.first_place[0]
            yield live, at, length, row
            more = (at > 0) & (at + length >= least)
            if not more.all():
                row, place, length, live, at = row[more], place[more], length[more], live[more], at[more]

    def stream(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, position, smallest owner) where the matching statistics of strings reach ``width``."""
        out = [(np.empty(0, dtype=np.int64),) * 3]
        for string, at, length, row in self.matches(data, lengths, self.width):
            long = np.flatnonzero(length >= self.width)
            if len(long):
                out.append((string[long], at[long], self.interval_owner[self.intervals.of(row[long])]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
