"""Rows with the awkward cases every operator meets, and a reader for the supplied tables."""

from __future__ import annotations

import random

SMALL = "/root/testdata/sf0.001"
WORDS = "amber birch cedar dune ember fjord grove heath inlet jetty knoll ledge marsh nook oasis pond quay ridge shoal tarn".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ly", "ing", ","]) for _ in range(n))


def awkward() -> list[tuple]:
    """(doc_id, text): nulls, empty and blank texts, repeated rows, ties, a long text, odd characters."""
    base = prose(1, 120)
    return [
        (5, base),
        (2, base),
        (2, base),
        (9, None),
        (10, ""),
        (11, " \n\t "),
        (None, base + " tail"),
        (12, "é ü ß 漢字 İ ΣΣ x\x1cy z \x00"),
        (13, "one two"),
        (14, prose(2, 20_000)),
        (15, "aaaa " * 400),
        (16, prose(3, 60) + "\n" + base[100:400] + "\n" + prose(4, 60)),
        (17, "no password here\nline\nline\nline"),
    ]


def frame(spark, rows=None):
    """The rows with extra columns whose names operators use themselves."""
    rows = awkward() if rows is None else rows
    return spark.createDataFrame(
        [(i, t, 1, "x", None) for i, t in rows], "doc_id bigint, text string, score int, spans string, fp double"
    )


def empty(spark):
    return frame(spark, [])
