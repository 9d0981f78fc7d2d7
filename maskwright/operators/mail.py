"""Classify messages by sender and recipient domains, and by what a scan finds in them.

A message is one row: ``message_id``, ``direction``, ``sender``, ``recipients`` (array), ``subject``,
``body``, ``sent_at``. All steps are projections inside that row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright import fixed_values as V
from maskwright.functions import spans as S
from maskwright.operators.detect import raw_spans

VIEWS = {
    "all": "true",
    "sensitive": "is_sensitive",
    "leaks": "leak_risk",
    "inbound": "direction = 'inbound'",
    "outbound": "direction = 'outbound'",
    "internal": "direction = 'internal'",
}


def domain_of(address: str) -> str:
    return (
        f"CASE WHEN contains({address}, '@') THEN lower(substring_index({address}, '@', -1)) "
        "ELSE '' END"
    )


def classify(messages: DataFrame, internal_domains: list[str]) -> DataFrame:
    """Add the boundary flags and ``external_domains``. An empty recipient list is on neither
    side, so no "all" or "any" holds for it."""
    listed = ", ".join(S.text_literal(d) for d in internal_domains)
    known = f"cast(array({listed}) AS array<string>)"
    return (
        messages.withColumns(
            {
                "sender_domain": F.expr(domain_of("sender")),
                "_domains": F.expr(f"transform(recipients, r -> {domain_of('r')})"),
            }
        )
        .withColumns(
            {
                "sender_internal": F.expr(f"array_contains({known}, sender_domain)"),
                "_inside": F.expr(f"transform(_domains, d -> array_contains({known}, d))"),
            }
        )
        .withColumns(
            {
                "all_recipients_internal": F.expr("size(_inside) > 0 AND forall(_inside, i -> i)"),
                "any_recipient_internal": F.expr("exists(_inside, i -> i)"),
                "fully_internal": F.expr(
                    "sender_internal AND size(_inside) > 0 AND forall(_inside, i -> i)"
                ),
                "crosses_boundary": F.expr("exists(_inside, i -> i <> sender_internal)"),
                "external_domains": F.expr(
                    f"array_sort(array_distinct(filter(concat(_domains, array(sender_domain)), "
                    f"d -> NOT array_contains({known}, d))))"
                ),
            }
        )
        .drop("_domains", "_inside")
    )


def scan(messages: DataFrame) -> DataFrame:
    """Scan subject and body apart, and add the per-message totals."""
    parts = ("subject", "body")
    df = S.hold(messages, {f"_raw_{p}": raw_spans(p) for p in parts})
    df = S.hold(df, {f"{p}_spans": S.merge(f"_raw_{p}") for p in parts}).drop(*[f"_raw_{p}" for p in parts])
    every = "concat(body_spans, subject_spans)"
    return df.withColumns(
        {
            **{
                f"{p}_redacted": F.expr(
                    S.redact(p, f"{p}_spans", lambda s: S.placeholder(f"{s}.label"))
                )
                for p in parts
            },
            "span_count": F.expr("cast(size(body_spans) + size(subject_spans) AS bigint)"),
            "by_label": F.expr(S.bind("both", every, S.count_by_label("both"))),
            "is_sensitive": F.expr("size(body_spans) + size(subject_spans) > 0"),
        }
    )


def assess(scanned: DataFrame) -> DataFrame:
    """Add the leak flag, the risk tier and the labels in order of priority."""
    order = "array(" + ", ".join(repr(k) for k in V.LABEL_ORDER) + ")"
    leak = "is_sensitive AND direction = 'outbound' AND NOT all_recipients_internal"
    return scanned.withColumns(
        {
            "leak_risk": F.expr(leak),
            "risk": F.expr(
                f"CASE WHEN {leak} THEN 'Risk' WHEN is_sensitive THEN 'Sensitive' ELSE 'No findings' END"
            ),
            "labels_by_priority": F.expr(f"filter({order}, k -> map_contains_key(by_label, k))"),
            "top_label": F.expr(
                f"coalesce(get(filter({order}, k -> map_contains_key(by_label, k)), 0), 'secret')"
            ),
        }
    )


def scan_all(messages: DataFrame, internal_domains: list[str]) -> DataFrame:
    """Classification, scan and risk of every message; one narrow pass."""
    return assess(scan(classify(messages, internal_domains)))


def view(assessed: DataFrame, name: str) -> DataFrame:
    """One of the listing views; an unknown name shows everything."""
    return assessed.where(VIEWS.get(name, VIEWS["all"]))


def by_id(assessed: DataFrame, message_id) -> DataFrame:
    return assessed.where(F.col("message_id") == F.lit(message_id))


def newest_first(assessed: DataFrame) -> DataFrame:
    return assessed.orderBy(F.desc("sent_at"), F.desc("message_id"))


def display_name(address: str) -> str:
    """``a.b-c_d@host`` as ``A B C D``."""
    words = f"split(substring_index({address}, '@', 1), '[._-]')"
    return (
        f"array_join(transform({words}, w -> concat(upper(substring(w, 1, 1)), substring(w, 2))), ' ')"
    )


def shorten(address: str) -> str:
    return (
        f"CASE WHEN length({address}) > 38 THEN concat(substring({address}, 1, 36), '…') "
        f"ELSE {address} END"
    )


def coverage_gaps(messages: DataFrame, scanned: DataFrame) -> DataFrame:
    """Messages that were not scanned exactly once: (message_id, expected, scanned)."""
    want = messages.select("message_id", F.lit(1).alias("w"), F.lit(0).alias("h"))
    have = scanned.select("message_id", F.lit(0).alias("w"), F.lit(1).alias("h"))
    return (
        want.unionAll(have)
        .groupBy("message_id")
        .agg(F.sum("w").alias("expected"), F.sum("h").alias("scanned"))
        .where("expected <> 1 OR scanned <> 1")
    )
