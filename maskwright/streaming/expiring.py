"""Review receipts of a long-running stream, whose state is freed when a receipt is closed.

Two forms, both with a watermark that trails the newest attempt by the lateness:

``closed_receipts`` keeps what may still decide of each open receipt, by bucket of tokens, and decides its attempts in order of time, however they
arrive within the lateness. A timer at the end of its life closes a receipt that nobody used.

``valid_exports`` joins the stream of prepared receipts with that of exports over the interval of a life. It is
exact where only these two occur and attempts come in order; a discard is not seen by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskwright import fixed_values as V
from maskwright.streaming.receipts import bucket, use_maps

LATENESS = "10 minutes"
_ISSUE = "token string, at bigint, event string, fingerprint string"
_ATTEMPT = "token string, at bigint, rank bigint, event string, action string, fingerprint string"
CLOSED = "token string, issue_at bigint, issue_event string, issue_fingerprint string, use_at bigint, use_event string, use_action string"


class _Receipts(StatefulProcessor):
    """The open receipts of a bucket of tokens, as a call of Python costs far more than a receipt. Of a token, the issue
    is set once no earlier prepare can arrive; waiting are, in order, the attempts that may still decide: before
    that all of them, after it the first valid use alone."""

    def __init__(self, life: int) -> None:
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.issues = handle.getListState("issues", _ISSUE)
        self.waiting = handle.getListState("waiting", _ATTEMPT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        issues, waiting = self._open()
        for frame in rows:
            columns = (frame[c] for c in ("token", "at", "rank", "event", "action", "fingerprint"))
            for token, a, r, e, x, p in zip(*columns, strict=True):
                mine = waiting.setdefault(token, [])
                mine.append((int(a), int(r), e, x, p))
                if token in issues and len(mine) > 64:  # a busy token
                    waiting[token] = self._useful(issues[token], mine)
        yield from self._settle(issues, waiting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._settle(*self._open(), timerValues.getCurrentWatermarkInMs())

    def _open(self) -> tuple[dict[str, tuple], dict[str, list[tuple]]]:
        issues = {token: tuple(issue) for token, *issue in self.issues.get()}
        waiting: dict[str, list[tuple]] = {}
        for token, *attempt in self.waiting.get():
            waiting.setdefault(token, []).append(tuple(attempt))
        return issues, waiting

    def close(self) -> None:
        pass

    def _useful(self, issue: tuple | None, waiting: list[tuple]) -> list[tuple]:
        waiting = sorted(waiting, key=lambda w: w[:2])
        if issue is None:
            return waiting
        at, _, mark = issue
        valid = (
            w for w in waiting
            if at <= w[0] < at + self.life and (w[3] == "discarded" or (w[3] == "exported" and w[4] is not None and w[4] == mark))
        )
        return [w for w, _ in zip(valid, range(1), strict=False)]

    def _settle(self, issues: dict[str, tuple], waiting: dict[str, list[tuple]], watermark: int) -> Iterator[pd.DataFrame]:
        """Decide what the watermark has passed, store the rest and ask to be called again."""
        now = watermark * 1000
        closed, open_issues, open_waiting, due = [], [], [], []
        for token in {**issues, **waiting}:
            issue = issues.get(token)
            rest = self._useful(issue, waiting.get(token, []))
            passed = 0
            while issue is None and passed < len(rest) and rest[passed][0] <= now:
                at, _, event, action, mark = rest[passed]
                passed += 1
                if action == "prepared":
                    issue = (at, event, mark)
            rest = self._useful(issue, rest[passed:]) if passed else rest
            use = None
            if issue is not None:
                if rest and rest[0][0] <= now:
                    use = (rest[0][0], rest[0][2], rest[0][3])
                elif issue[0] + self.life <= now:
                    use = (None, None, "expired")
            if use is not None:
                closed.append((token, *issue, *use))
                continue
            if issue is not None:
                open_issues.append((token, *issue))
                due.append(issue[0] + self.life)
            open_waiting += [(token, *w) for w in rest]
            due += [w[0] for w in rest[:1]]
        for state, rows in ((self.issues, open_issues), (self.waiting, open_waiting)):
            if rows:
                state.put(rows)
            else:
                state.clear()
        if due:
            self.handle.registerTimer(max(watermark + 1, -(-min(due) // 1000) - 1))
        if closed:
            yield pd.DataFrame(closed, columns=[c.split()[0] for c in CLOSED.split(", ")]).astype({"use_at": "Int64"})


def closed_receipts(
    attempts: DataFrame, life_seconds: int = V.RECEIPT_LIFE_SECONDS, lateness: str = LATENESS
) -> DataFrame:
    """One row per receipt when it is closed: exported, discarded or expired; times in microseconds (append mode).

    As ``maskwright.operators.review.receipts`` decides, for attempts that arrive within ``lateness`` of the newest, in
    whatever order; older ones are left out (``run.late_rows`` keeps them). What closes a receipt is reported
    once the watermark has passed it, and its state goes then. A token that is prepared again after that gives
    another row: ``first_receipts`` keeps the first. Attempts that decide nothing are left out before the shuffle.
    """
    use_maps(attempts.sparkSession)
    rows = attempts.where("token IS NOT NULL AND (action IN ('prepared', 'discarded') OR (action = 'exported' AND confirmed))")
    rows = rows.withWatermark("occurred_at", lateness).select(
        bucket(), "token", "occurred_at", F.unix_micros("occurred_at").alias("at"), F.col("event_id").cast("long").alias("rank"),
        F.col("event_id").cast("string").alias("event"), "action", "fingerprint",
    )
    return rows.groupBy("bucket").transformWithStateInPandas(
        _Receipts(int(life_seconds) * 1_000_000), CLOSED, "Append", "EventTime"
    )


def first_receipts(closed: DataFrame) -> DataFrame:
    """The first receipt of each token, from the stored rows of closed ones."""
    order = F.struct("issue_at", F.col("issue_event").cast("long"))
    return closed.groupBy("token").agg(F.min_by(F.struct(*closed.columns), order).alias("r")).select("r.*")


def _sides(attempts: DataFrame, lateness: str) -> tuple[DataFrame, DataFrame]:
    rows = attempts.where("token IS NOT NULL")
    prepared = rows.where("action = 'prepared'").withWatermark("occurred_at", lateness).selectExpr(
        "token", "occurred_at AS prepared_at", "event_id AS prepared_event", "fingerprint AS prepared_fingerprint"
    )
    exports = rows.where("action = 'exported' AND confirmed").withWatermark("occurred_at", lateness).selectExpr(
        "token AS export_token", "occurred_at AS exported_at", "event_id AS export_event", "fingerprint AS export_fingerprint"
    )
    return prepared, exports


def _within(life_seconds: int):
    return F.expr(
        f"token = export_token AND prepared_fingerprint = export_fingerprint AND exported_at >= prepared_at "
        f"AND exported_at < prepared_at + INTERVAL {int(life_seconds)} SECONDS"
    )


def valid_exports(attempts: DataFrame, other: DataFrame, life_seconds: int = V.RECEIPT_LIFE_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """Exports within the life of their receipt, each receipt once: an interval join of two streams with a watermark
    each, then the first export seen of a token (append mode). ``other`` is the same stream read a second time.

    Both sides forget rows when no partner can arrive any more.
    """
    prepared, exports = _sides(attempts, lateness)[0], _sides(other, lateness)[1]
    found = prepared.join(exports, _within(life_seconds), "inner")
    # one event time at most may go on: the export's
    found = found.select("token", "prepared_event", F.unix_micros("prepared_at").alias("prepared_micros"), "export_event", "exported_at")
    return found.dropDuplicatesWithinWatermark(["token"])


def unexported(attempts: DataFrame, other: DataFrame, life_seconds: int = V.RECEIPT_LIFE_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """Prepared receipts that no export met in their life, once the watermark has passed its end (append mode)."""
    prepared, exports = _sides(attempts, lateness)[0], _sides(other, lateness)[1]
    found = prepared.join(exports, _within(life_seconds), "left_outer")
    return found.where("export_event IS NULL").select("token", "prepared_event", F.unix_micros("prepared_at").alias("prepared_micros"))
