"""Messages as they arrive: scan, running counters, alerts and windows.

The projections of a batch scan are stateless, so they apply to a stream as they are. Functions
return streaming DataFrames; the caller chooses sink, trigger and checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators.dashboard import COUNTERS, counter_columns, counters
from maskwright.operators.mail import scan_all, shorten

LATENESS = "10 minutes"


def live_scan(messages: DataFrame, internal_domains: list[str]) -> DataFrame:
    return scan_all(messages, internal_domains)


def live_counters(assessed: DataFrame) -> DataFrame:
    """Counters since the start of the query; complete or update mode."""
    return counters(assessed)


def live_label_totals(assessed: DataFrame) -> DataFrame:
    return (
        assessed.select(F.explode("by_label").alias("label", "n"))
        .groupBy("label")
        .agg(F.sum("n").alias("n"))
    )


def alerts(assessed: DataFrame) -> DataFrame:
    """One row per message that may leak, with what to show; append mode."""
    return assessed.where("leak_risk").select(
        "message_id",
        "sent_at",
        "top_label",
        "subject",
        "sender",
        F.expr(f"array_join(transform(recipients, r -> {shorten('r')}), ', ')").alias("recipients"),
    )


def _windowed(assessed: DataFrame, window: Column, lateness: str, *keys: str) -> DataFrame:
    return (
        assessed.withWatermark("sent_at", lateness)
        .groupBy(window.alias("w"), *keys)
        .agg(*counter_columns(), F.sum("span_count").alias("spans"))
        .select("w.start", "w.end", *keys, *COUNTERS, "spans")
    )


def windowed_counters(
    assessed: DataFrame, length: str = "1 hour", slide: str | None = None, lateness: str = LATENESS
) -> DataFrame:
    """Counters per tumbling window, or per sliding window when ``slide`` is given."""
    return _windowed(assessed, F.window("sent_at", length, slide), lateness)


def sender_sessions(assessed: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Counters per sender and burst of activity."""
    return _windowed(assessed, F.session_window("sent_at", gap), lateness, "sender")
