"""Review receipts as a stream of attempts: one state per receipt, kept for good.

Python is called once for a bucket of tokens and a micro-batch, as a call costs far more than a receipt; the
state of each receipt is an entry of its bucket's map, so a micro-batch reads and writes those of its own tokens only.

An attempt has ``event_id``, ``occurred_at``, ``action``, ``token``, ``fingerprint`` and ``confirmed``,
as in ``maskwright.operators.review``, whose results these are when attempts arrive in order. Within
one micro-batch attempts are put in order; across micro-batches a decision stands once it is made,
as an export cannot be taken back. There is no watermark, so no late attempt is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskwright import fixed_values as V

# Buckets of tokens. State is kept by bucket, so a stream that has begun keeps the number.
BUCKETS = 4096
_STORE = "spark.sql.streaming.stateStore.providerClass"

_STATE = (
    "version bigint, issue_at bigint, issue_event string, issue_fingerprint string, "
    "use_at bigint, use_event string, use_action string"
)
CHANGES = f"token string, {_STATE}"


def _advance(state: tuple, attempts: list[tuple], life: int) -> tuple:
    """The state of a receipt after attempts (at, event, action, fingerprint) in their order."""
    version, issue_at, issue_event, issue_print, use_at, use_event, use_action = state
    for at, event, action, print_ in attempts:
        if issue_at is None:
            if action == "prepared":
                issue_at, issue_event, issue_print = at, event, print_
        elif use_at is None and action != "prepared" and issue_at <= at < issue_at + life:
            if action == "discarded" or (print_ is not None and print_ == issue_print):
                use_at, use_event, use_action = at, event, action
    return version + 1, issue_at, issue_event, issue_print, use_at, use_event, use_action


def use_maps(spark: SparkSession) -> None:
    """Maps, lists and timers need the state store on disk; to be set before the first such stream starts."""
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def bucket(token: str = "token") -> Column:
    return F.expr(f"pmod(hash({token}), {BUCKETS})").alias("bucket")


class _Receipts(StatefulProcessor):
    """The tokens of a bucket, each with its own state."""

    def __init__(self, life: int) -> None:
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getMapState("receipts", "token string", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        any_before = self.states.exists()
        before: dict[str, tuple] = {}
        waiting: dict[str, list[tuple]] = {}
        for frame in rows:
            for token, *row in zip(*(frame[c] for c in ("token", "at", "event_id", "event", "action", "fingerprint")), strict=True):
                if token not in before:
                    known = self.states.getValue((token,)) if any_before else None
                    before[token] = (0, None, None, None, None, None, None) if known is None else tuple(known)
                # Only what may still decide is kept of a busy token.
                state = before[token]
                if state[4] is None and (state[1] is None or row[3] != "prepared"):
                    waiting.setdefault(token, []).append(row)
        changed = []
        for token, attempts in waiting.items():
            attempts.sort(key=lambda r: r[:2])
            after = _advance(before[token], [(int(at), event, action, mark) for at, _, event, action, mark in attempts], self.life)
            if after[1:] != before[token][1:]:
                self.states.updateValue((token,), after)
                changed.append((token, *after))
        if changed:
            yield pd.DataFrame(changed, columns=[c.split()[0] for c in CHANGES.split(", ")]).astype({"issue_at": "Int64", "use_at": "Int64"})

    def close(self) -> None:
        pass


def receipt_changes(attempts: DataFrame, life_seconds: int = V.RECEIPT_LIFE_SECONDS) -> DataFrame:
    """The state of each receipt after each micro-batch that changed it (update mode); times in microseconds.

    The row of a token with the highest ``version`` is its present state. Attempts that decide nothing (exports
    without confirmation, rows without token) are left out before the shuffle.
    """
    life = int(life_seconds) * 1_000_000
    order_type = dict(attempts.dtypes)["event_id"]
    use_maps(attempts.sparkSession)
    rows = attempts.where("token IS NOT NULL AND (action IN ('prepared', 'discarded') OR (action = 'exported' AND confirmed))")
    return (
        rows.select(
            bucket(),
            "token",
            F.unix_micros("occurred_at").alias("at"),
            F.col("event_id").cast(order_type).alias("event_id"),
            F.col("event_id").cast("string").alias("event"),
            "action",
            "fingerprint",
        )
        .groupBy("bucket")
        .transformWithStateInPandas(_Receipts(life), CHANGES, "Update", "None")
    )


def latest(changes: DataFrame) -> DataFrame:
    """Issued receipts in their present state, from the stored changes."""
    newest = changes.groupBy("token").agg(F.max_by(F.struct(*changes.columns), "version").alias("r")).select("r.*")
    return newest.where("issue_at IS NOT NULL")


def exported(receipts: DataFrame) -> DataFrame:
    """Receipts that were exported, each once, with the attempt that did it."""
    return receipts.where("use_action = 'exported'")


def unexported(receipts: DataFrame) -> DataFrame:
    """Receipts without an export: discarded, run out, or open at the end of what arrived."""
    return receipts.where("use_action IS DISTINCT FROM 'exported'")
