"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per text. The ledger keeps the measurements and one bit per failed rule;
a policy is a versioned mask of bits, so changing a policy or asking what a rule costs needs no text.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.batches import map_texts

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

# Rule: its bit, and the condition over the measurements under which a text fails. Stored ledgers hold these bits: a
# new rule takes the next free bit, and no bit is ever given to another rule.
RULES: dict[str, tuple[int, str]] = {
    "too_few_words": (0, "n_words < 10"),
    "repeated_windows": (1, "100 * n_repeat_words > 20 * n_words"),
    "word_length": (2, "word_chars > 30 * n_words"),
    "symbols": (3, "10 * n_symbols > 3 * word_chars"),
    "repeated_lines": (4, "10 * n_dup_lines > 6 * n_lines"),
}

# Policy version: the rules it applies. The first two rules are part of every policy. A published version
# never changes; other rules make a new version.
POLICIES: dict[str, list[str]] = {
    "v1": ["too_few_words", "repeated_windows"],
    "v2": ["too_few_words", "repeated_windows", "word_length", "symbols", "repeated_lines"],
}

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that stand in the text twice or more. Exact: windows are ranked
    pair by pair, so no hash of a window is compared."""
    n = len(words)
    if n < 6:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)

    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    two = paired(ids[:-1], ids[1:])
    four = paired(two[:-2], two[2:])
    window = four[:-1] * (int(ids.max()) + 1) + ids[4:]
    _, back, counts = np.unique(window, return_inverse=True, return_counts=True)
    start = np.flatnonzero(counts[back] > 1)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + 5, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()  # bytes are split at ASCII white space only
    seen: set[str] = set()
    lines = doubles = 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            lines += 1
            doubles += line in seen
            seen.add(line)
    return (
        len(words),
        len(text) - sum(text.count(c) for c in _SPACES),
        sum(text.count(c) for c in _SYMBOLS),
        doubles,
        _repeat_words(words),
        lines,
    )


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, the measurements, and ``failed``, the bits of failed rules.

    A null text counts as empty: no words, so it fails ``too_few_words``. Texts are measured whole;
    null and repeated ids are kept; other columns are not read. No shuffle.
    """

    def work(texts: list[str | None]) -> list:
        rows = np.array([measure(t) for t in texts], dtype=np.int64).reshape(-1, len(MEASURES))
        return [np.ascontiguousarray(rows[:, k]) for k in range(len(MEASURES))]

    measured = map_texts(docs, id_col, text_col, [T.StructField(m, T.LongType()) for m in MEASURES], work)
    bits = [F.when(F.expr(c), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in RULES.values()]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed.cast("long"))


def mask(rules: Iterable[str]) -> int:
    return sum(1 << RULES[r][0] for r in set(rules))


def passes(policy: str) -> Column:
    """Whether a ledger row passes a policy version."""
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(rows: DataFrame) -> DataFrame:
    """Per policy version and rule of it: rows that fail the rule, and rows that fail nothing else of the policy.

    Rows are first counted per combination of bits (at most 2 ** number of rules), so the texts and
    even the ledger are read once for all policies. An empty ledger gives no rows.
    """
    combos = rows.groupBy("failed").agg(F.count("*").alias("n"))
    cases = [
        F.struct(
            F.lit(version).alias("policy"),
            F.lit(rule).alias("rule"),
            F.lit(mask([rule])).cast("long").alias("bit"),
            F.lit(mask(rules)).cast("long").alias("all_bits"),
        )
        for version, rules in POLICIES.items()
        for rule in rules
    ]
    spread = combos.select("failed", "n", F.inline(F.array(*cases)))
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0
    alone = F.col("failed").bitwiseAND(F.col("all_bits")) == F.col("bit")
    return spread.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_failed_alone"),
    )
