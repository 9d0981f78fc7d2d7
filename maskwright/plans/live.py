"""The streaming forms, run to the end of what the data folder holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.operators import dashboard as B
from maskwright.plans import mails as M
from maskwright.plans import oracle as O
from maskwright.plans.reviews import _decided
from maskwright.sources.tables import INTERNAL_DOMAINS, Tables
from maskwright.streaming import expiring as E
from maskwright.streaming import live as L
from maskwright.streaming import receipts as R
from maskwright.streaming.run import drain, drain_changes, drain_merged, drain_totals

QUERIES = {}
ORACLE = {}


def _live(spark, folder):
    return L.live_scan(Tables(spark, folder).message_stream(spark.sparkContext.defaultParallelism), INTERNAL_DOMAINS)


def j1_live_scan(spark, folder):
    rows = _live(spark, folder).select("message_id", "span_count", "risk", "crosses_boundary", "body_redacted")
    return drain(rows, "live-scan")


QUERIES["j1_live_scan"] = j1_live_scan
ORACLE["j1_live_scan"] = (
    O.with_(
        O.MESSAGES, M._CLASSIFIED, M._SPANS, M._ASSESSED,
        "ps AS (SELECT message_id, part, text FROM parts)", O.redacted("r", "ps", "spans", ["message_id", "part"]),
    )
    + f"SELECT message_id, span_count, {M._RISK} AS risk, crosses_boundary, redacted AS body_redacted FROM assessed "
    "JOIN r USING (message_id) WHERE part = 'body'"
)

QUERIES["j2_live_counters"] = lambda spark, folder: drain_totals(L.live_counters(_live(spark, folder)), "live-counters")
ORACLE["j2_live_counters"] = M.ORACLE["f1_counters"]


def j8_replayed_counters(spark, folder):
    """A second run over the same input starts from zero."""
    drain_totals(L.live_counters(_live(spark, folder)), "first-run")
    return drain_totals(L.live_counters(_live(spark, folder)), "second-run")


QUERIES["j8_replayed_counters"] = j8_replayed_counters
ORACLE["j8_replayed_counters"] = M.ORACLE["f1_counters"]

QUERIES["j2_live_label_totals"] = lambda spark, folder: drain_totals(L.live_label_totals(_live(spark, folder)), "live-labels")
ORACLE["j2_live_label_totals"] = M.ORACLE["f2_label_totals"]

QUERIES["j3_leak_alerts"] = lambda spark, folder: drain(
    L.alerts(_live(spark, folder)).drop("sent_at"), "live-alerts"
)
ORACLE["j3_leak_alerts"] = (
    M.SCANNED
    + f"SELECT message_id, {M._TOP} AS top_label, subject, sender, array_to_string(list_transform(recipients, "
    "lambda r: CASE WHEN length(r) > 38 THEN substr(r, 1, 36) || '…' ELSE r END), ', ') AS recipients FROM assessed WHERE leak_risk"
)


def _windows(stream, name):
    """All windows, open ones included, with bounds as microseconds."""
    rows = stream.withColumns({"start_us": F.unix_micros("start"), "end_us": F.unix_micros("end")})
    return drain_totals(rows.drop("start", "end"), name)


def _merged_windows(stream, name):
    """All windows by update mode: a batch gives those that it changed, and state ends with the watermark."""
    rows = stream.withColumns({"start_us": F.unix_micros("start"), "end_us": F.unix_micros("end")})
    return drain_merged(rows.drop("start", "end"), name, ["start_us", "end_us"])


_FIGURES = ", ".join(f"count(*) FILTER (WHERE {cond}) AS {name}" for name, cond in B.COUNTERS.items())
_US = 86_400_000_000

QUERIES["j4_daily_windows"] = lambda spark, folder: _merged_windows(
    L.windowed_counters(_live(spark, folder), "1 day"), "live-days"
)
ORACLE["j4_daily_windows"] = (
    M.SCANNED
    + f"SELECT epoch_us(sent_at) // {_US} * {_US} AS start_us, start_us + {_US} AS end_us, {_FIGURES}, "
    f"cast(sum(span_count) AS bigint) AS spans FROM assessed GROUP BY ALL"
)

QUERIES["j4_sliding_windows"] = lambda spark, folder: _merged_windows(
    L.windowed_counters(_live(spark, folder), "2 days", "1 day"), "live-slides"
)
ORACLE["j4_sliding_windows"] = (
    M.SCANNED
    + f"SELECT epoch_us(sent_at) // {_US} * {_US} - k * {_US} AS start_us, start_us + 2 * {_US} AS end_us, {_FIGURES}, "
    f"cast(sum(span_count) AS bigint) AS spans FROM assessed, range(0, 2) t(k) GROUP BY ALL"
)

_GAP = 30 * _US
QUERIES["j4_sender_sessions"] = lambda spark, folder: _windows(
    L.sender_sessions(_live(spark, folder), "720 hours"), "live-sessions"
)
ORACLE["j4_sender_sessions"] = (
    M.SCANNED
    + f", b AS (SELECT *, epoch_us(sent_at) AS us, coalesce(us - lag(us) OVER (PARTITION BY sender ORDER BY us) >= {_GAP}, true) AS fresh FROM assessed), "
    "n AS (SELECT *, sum(fresh::int) OVER (PARTITION BY sender ORDER BY us, message_id) AS no FROM b) "
    f"SELECT * EXCLUDE (no) FROM (SELECT sender, no, min(us) AS start_us, max(us) + {_GAP} AS end_us, {_FIGURES}, "
    f"cast(sum(span_count) AS bigint) AS spans FROM n GROUP BY sender, no)"
).replace(") , b AS", "), b AS")


def _receipts(spark, folder):
    attempts = Tables(spark, folder).attempt_stream("prepared", "exported", "discarded")
    return R.latest(drain_changes(R.receipt_changes(attempts), "receipts"))


QUERIES["j5_valid_exports"] = lambda spark, folder: R.exported(_receipts(spark, folder)).select(
    F.col("use_event").cast("bigint").alias("event_id"), "token", F.col("issue_at").alias("prepared_micros")
)
ORACLE["j5_valid_exports"] = (
    _decided() + "SELECT event_id, token, epoch_us(issued_at) AS prepared_micros FROM decided WHERE outcome = 'exported'"
)

QUERIES["j6_exported_receipts"] = lambda spark, folder: R.exported(_receipts(spark, folder)).select("token")
ORACLE["j6_exported_receipts"] = _decided() + "SELECT token FROM decided WHERE outcome = 'exported'"

QUERIES["j7_unexported"] = lambda spark, folder: R.unexported(_receipts(spark, folder)).select(
    "token", F.col("issue_at").alias("prepared_micros")
)
ORACLE["j7_unexported"] = (
    _decided()
    + "SELECT token, epoch_us(issued_at) AS prepared_micros FROM decided WHERE outcome = 'prepared' "
    "AND token NOT IN (SELECT token FROM decided WHERE outcome = 'exported')"
)


def _all_attempts(spark, folder):
    return Tables(spark, folder).attempt_stream("prepared", "exported", "discarded")


# What a stream may close is what its watermark has passed: the newest attempt less ten minutes.
_LATE = 600_000_000
_MARK = f"(epoch_us(max(occurred_at)) // 1000) * 1000 - {_LATE}"

QUERIES["j5_closed_receipts"] = lambda spark, folder: E.first_receipts(
    drain(E.closed_receipts(_all_attempts(spark, folder)), "closed-receipts")
).select("token", "issue_at", F.col("use_event").cast("bigint").alias("use_event"), "use_action")
ORACLE["j5_closed_receipts"] = (
    _decided()
    + f"SELECT token, issue_at, use_event, coalesce(use_action, 'expired') AS use_action FROM (SELECT token, "
    "epoch_us(min(issued_at)) AS issue_at, max(event_id) FILTER (WHERE outcome IN ('exported', 'discarded')) AS use_event, "
    "max(outcome) FILTER (WHERE outcome IN ('exported', 'discarded')) AS use_action, "
    "max(epoch_us(occurred_at)) FILTER (WHERE outcome IN ('exported', 'discarded')) AS use_at FROM decided GROUP BY token) "
    f"WHERE coalesce(use_at, issue_at + {_LATE}) <= (SELECT {_MARK} FROM attempts WHERE action <> 'exported' OR confirmed)"
)

_PAIRS = (
    "p AS (SELECT token, occurred_at AS t, fingerprint, event_id FROM attempts WHERE action = 'prepared'), "
    "x AS (SELECT token, occurred_at AS t, fingerprint FROM attempts WHERE action = 'exported' AND confirmed) "
)
_MEETS = "x.token = p.token AND x.fingerprint = p.fingerprint AND x.t >= p.t AND x.t < p.t + INTERVAL 600 SECONDS"

QUERIES["j6_joined_exports"] = lambda spark, folder: (
    drain(E.valid_exports(_all_attempts(spark, folder), _all_attempts(spark, folder)), "joined-exports").select("token").distinct()
)
ORACLE["j6_joined_exports"] = O.with_(O.ATTEMPTS, _PAIRS) + f"SELECT DISTINCT p.token FROM p JOIN x ON {_MEETS}"

QUERIES["j7_joined_unexported"] = lambda spark, folder: drain(
    E.unexported(_all_attempts(spark, folder), _all_attempts(spark, folder)), "joined-unexported"
).select("token", "prepared_event", "prepared_micros")
ORACLE["j7_joined_unexported"] = (
    O.with_(O.ATTEMPTS, _PAIRS)
    + "SELECT token, event_id AS prepared_event, epoch_us(t) AS prepared_micros FROM p WHERE NOT EXISTS (SELECT 1 FROM x WHERE "
    + _MEETS
    + f") AND epoch_us(t) + {_LATE} < least((SELECT epoch_us(max(t)) FROM p), (SELECT epoch_us(max(t)) FROM x)) - {_LATE}"
)
