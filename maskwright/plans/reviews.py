"""Review receipts decided from a log of attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright import fixed_values as V
from maskwright.operators import review as R
from maskwright.plans import oracle as O
from maskwright.sources.tables import Tables

QUERIES = {}
ORACLE = {}

def _decided(life: int = V.RECEIPT_LIFE_SECONDS) -> str:
    """Outcomes with window functions over the attempts of a receipt."""
    return O.with_(
        O.ATTEMPTS,
        "o AS (SELECT *, row_number() OVER (ORDER BY occurred_at, event_id) AS pos FROM attempts)",
        "p AS (SELECT *, first_value(CASE WHEN action = 'prepared' THEN pos END IGNORE NULLS) OVER w AS issue, "
        "first_value(CASE WHEN action = 'prepared' THEN occurred_at END IGNORE NULLS) OVER w AS issued_at, "
        "first_value(CASE WHEN action = 'prepared' THEN fingerprint END IGNORE NULLS) OVER w AS right_print FROM o "
        "WINDOW w AS (PARTITION BY token ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))",
        f"q AS (SELECT *, issued_at + INTERVAL {life} SECONDS AS expires FROM p)",
        "u AS (SELECT *, min(CASE WHEN pos > issue AND occurred_at < expires AND (action = 'discarded' OR (action = 'exported' "
        "AND confirmed AND fingerprint = right_print)) THEN pos END) OVER (PARTITION BY token) AS used FROM q)",
        "decided AS (SELECT *, CASE WHEN action = 'prepared' AND pos = issue THEN 'prepared' "
        "WHEN action = 'prepared' THEN 'duplicate_receipt' "
        "WHEN action = 'exported' AND confirmed IS NOT TRUE THEN 'review_required' "
        "WHEN action = 'discarded' AND pos = used THEN 'discarded' WHEN action = 'discarded' THEN 'ignored' "
        "WHEN pos = used THEN 'exported' "
        "WHEN issue IS NOT NULL AND pos > issue AND occurred_at < expires AND (used IS NULL OR pos < used) THEN 'candidate_changed' "
        "ELSE 'review_unavailable' END AS outcome FROM u)",
    )


def _attempts(spark, folder):
    return Tables(spark, folder).attempts()


QUERIES["h2_receipts"] = lambda spark, folder: R.receipts(_attempts(spark, folder)).select(
    "token", F.col("issue.event_id").alias("event_id"), F.col("issue.occurred_at").alias("issued_at"), "expires"
)
ORACLE["h2_receipts"] = (
    _decided() + "SELECT token, event_id, occurred_at AS issued_at, expires FROM decided WHERE outcome = 'prepared'"
)

QUERIES["h3_outcomes"] = lambda spark, folder: R.reconcile(_attempts(spark, folder)).select(
    "event_id", "token", "action", "outcome"
)
ORACLE["h3_outcomes"] = _decided() + "SELECT event_id, token, action, outcome FROM decided"

# A longer life, so that use rather than expiry decides.
QUERIES["h4_outcomes_long_life"] = lambda spark, folder: (
    R.reconcile(_attempts(spark, folder), 86_400).groupBy("action", "outcome").agg(F.count("*").alias("n"))
)
ORACLE["h4_outcomes_long_life"] = (
    _decided(86_400) + "SELECT action, outcome, count(*) AS n FROM decided GROUP BY action, outcome"
)

def h5_discards(spark, folder):
    """Discards per receipt, added up in two steps so that a busy receipt is not one task."""
    rows = R.reconcile(_attempts(spark, folder)).where("action = 'discarded'")
    rows = rows.select("token", "outcome", F.expr("pmod(hash(event_id), 64)").alias("salt")).repartition("token", "salt")
    part = rows.groupBy("token", "salt").agg(F.count("*").alias("n"), F.expr("count_if(outcome = 'discarded')").alias("d"))
    return part.groupBy("token").agg(F.sum("n").alias("attempts"), F.sum("d").alias("discarded"))


QUERIES["h5_discards"] = h5_discards
ORACLE["h5_discards"] = (
    _decided()
    + "SELECT token, count(*) AS attempts, count(*) FILTER (WHERE outcome = 'discarded') AS discarded FROM decided "
    "WHERE action = 'discarded' GROUP BY token"
)

_AUDIT_SQL = (
    f"SELECT event_id, occurred_at, '{V.REVIEW_ACTOR}' AS actor, outcome AS action, use_case, engine, "
    f"'{V.POLICY_VERSION}' AS policy_version, span_count, manual_mask_count FROM decided "
    "WHERE outcome IN ('prepared', 'exported', 'discarded')"
)
QUERIES["h6_audit_events"] = lambda spark, folder: R.audit_events(R.reconcile(_attempts(spark, folder)))
ORACLE["h6_audit_events"] = _decided() + _AUDIT_SQL

QUERIES["g4_last_events"] = lambda spark, folder: R.last_events(R.audit_events(R.reconcile(_attempts(spark, folder))))
ORACLE["g4_last_events"] = _decided() + _AUDIT_SQL + f" ORDER BY occurred_at DESC, event_id DESC LIMIT {V.MAX_EVENTS_LISTED}"

QUERIES["h7_backlog"] = lambda spark, folder: R.backlog(_attempts(spark, folder), 86_400)
ORACLE["h7_backlog"] = (
    _decided(86_400)
    + ", x AS (SELECT occurred_at AS instant, 1 AS c FROM decided WHERE outcome = 'prepared' UNION ALL SELECT coalesce(u.occurred_at, d.expires), -1 "
    "FROM decided d LEFT JOIN decided u ON u.token = d.token AND u.pos = d.used WHERE d.outcome = 'prepared') "
    f"SELECT instant, cast(open AS bigint) AS open, open >= {V.MAX_PENDING_REVIEWS} AS \"full\" FROM "
    "(SELECT instant, sum(sum(c)) OVER (ORDER BY instant) AS open FROM x GROUP BY instant)"
).replace(") , x AS", "), x AS")

QUERIES["h8_unconfirmed"] = lambda spark, folder: (
    R.reconcile(_attempts(spark, folder)).where("outcome = 'review_required'").select("event_id", "confirmed")
)
ORACLE["h8_unconfirmed"] = (
    O.with_(O.ATTEMPTS) + "SELECT event_id, confirmed FROM attempts WHERE action = 'exported' AND confirmed IS NOT TRUE"
)
