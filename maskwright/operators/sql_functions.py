"""Detection as SQL functions, for users who write SQL text only.

``create(spark)`` adds temporary functions to the session. Each is defined by an SQL expression, so a query
that calls them is one plan of built-in functions: no Python worker, and nothing to ship to executors.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from maskwright import fixed_values as V
from maskwright.functions import spans as S
from maskwright.operators.credentials import credential_spans
from maskwright.operators.detect import JAVA_RULES, raw_spans, rule_spans

_KNOWN = ", ".join(f"'{k}'" for k in [*V.LABELS, V.MANUAL_LABEL])


def definitions() -> dict[str, tuple[str, str, str]]:
    """Name of a function: its parameters, result type and body.

    A null argument gives null. Arguments are bound to names before use, so an argument that is itself
    a scan runs once however often the body mentions it.
    """

    def over(body: str, *names: str) -> str:
        given = " OR ".join(f"{n} IS NULL" for n in names)
        for n in names:
            body = S.bind(f"{n}_", n, body)
        return f"CASE WHEN {given} THEN NULL ELSE {body} END"

    detected = S.bind("raw", raw_spans("content_"), S.merge("raw"))
    redacted = S.redact("content_", "spans_", lambda s: S.placeholder(f"{s}.label"))
    checked = f"({S.is_valid('spans_', 'content_')} AND forall(spans_, v -> v.label IN ({_KNOWN})))"
    found = {
        "find_spans": ("content STRING", S.SPANS, over(detected, "content")),
        "find_credentials": ("content STRING", S.SPANS, over(credential_spans("content_"), "content")),
        "merge_spans": (f"spans {S.SPANS}", S.SPANS, over(S.merge("spans_"), "spans")),
        "valid_spans": (f"content STRING, spans {S.SPANS}", "BOOLEAN", over(checked, "content", "spans")),
        "redact_spans": (f"content STRING, spans {S.SPANS}", "STRING", over(redacted, "content", "spans")),
        "count_spans": (f"spans {S.SPANS}", "MAP<STRING, BIGINT>", over(S.count_by_label("spans_"), "spans")),
        "span_text": ("content STRING, first INT, last INT", "STRING", S.cut("content", "first", "last")),
        "span_placeholder": ("label STRING", "STRING", S.placeholder("label")),
    }
    for rule in JAVA_RULES:
        found[f"find_{rule}"] = ("content STRING", S.SPANS, over(rule_spans("content_", rule), "content"))
    return found


def create(spark: SparkSession, prefix: str = "mw_") -> list[str]:
    """Create the functions in the session, each under ``prefix`` and its name; returns the names."""
    names = []
    for name, (parameters, result, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN {body}")
        names.append(prefix + name)
    return names
