"""Sharing-policy queries: requests made from messages and from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright import fixed_values as V
from maskwright.functions import spans as S
from maskwright.operators import detect as D
from maskwright.operators import prepare as P
from maskwright.plans import oracle as O
from maskwright.sources import requests as Q
from maskwright.sources.scratch import scratch_folder
from maskwright.sources.tables import INTERNAL_DOMAINS, Tables
from maskwright.sources.texts import export_reviewed

QUERIES = {}
ORACLE = {}

# Email requests from messages. Some bodies already hold a placeholder; every fifth has manual
# masks, one of which is out of range in every thirty-fifth; some have no usable routing.
_BODY = (
    "body || CASE WHEN message_id % 3 = 0 THEN ' [PRIVATE_PERSON_1] [SECRET_1]' ELSE '' END || "
    "CASE WHEN message_id % 4 = 1 THEN ' ' || subject || ' ' || body ELSE '' END"
)
_RECIPIENTS = "array_join(transform(recipients, r -> concat('Desk <', r, '>')), ', ')"
_RECIPIENTS_SQL = "array_to_string(list_transform(recipients, lambda r: 'Desk <' || r || '>'), ', ')"
_MASK_END = "CASE WHEN message_id % 35 = 0 THEN 99999 ELSE 6 + message_id % 9 END"


def _email_requests(spark, folder) -> DataFrame:
    m = Tables(spark, folder).messages(D.spread)
    mask = f"named_struct('field', 'body', 'start', cast(message_id % 5 AS int), 'end', cast({_MASK_END} AS int))"
    second = "named_struct('field', 'subject', 'start', 0, 'end', 5)"
    return m.select(
        F.col("message_id").alias("request_id"),
        F.lit("email").alias("use_case"),
        F.expr(
            f"map('sender', sender, 'recipients', {_RECIPIENTS}, 'subject', subject, 'body', {_BODY})"
        ).alias("fields"),
        F.expr(
            f"CASE WHEN message_id % 5 = 0 THEN array({mask}, {second}) ELSE cast(null AS {P.MASKS}) END"
        ).alias("manual_masks"),
    )


def _ticket_requests(spark, folder) -> DataFrame:
    """Every document as a ticket or a prompt, whole."""
    docs = Tables(spark, folder).read("documents").select("doc_id", "text")
    return D.spread(docs).select(
        F.col("doc_id").alias("request_id"),
        F.expr("CASE doc_id % 3 WHEN 0 THEN 'ai_prompt' WHEN 1 THEN 'support_ticket' ELSE 'memo' END").alias("use_case"),
        F.expr("map('text', text)").alias("fields"),
        F.expr(f"cast(null AS {P.MASKS})").alias("manual_masks"),
    )


def _prepared(spark, folder) -> DataFrame:
    return P.prepare(_email_requests(spark, folder), internal_domains=INTERNAL_DOMAINS)


def _tickets(spark, folder) -> DataFrame:
    return P.prepare(_ticket_requests(spark, folder))


# --- reference SQL for the email requests ---

_REQUESTS = (
    f"req AS (SELECT message_id AS request_id, sender, {_RECIPIENTS_SQL} AS recipients, subject, {_BODY} AS body, "
    f"recipients AS rcpt, message_id % 5 = 0 AS masked, message_id % 5 AS m_start, {_MASK_END} AS m_end FROM messages)"
)
_VERDICT = (
    "verdict AS (SELECT *, CASE WHEN masked AND m_end > length(body) THEN 'invalid_mask' "
    "WHEN NOT contains(sender, '@') OR len(rcpt) = 0 THEN 'invalid_email_routing' END AS reject_reason FROM req)"
)
_FIELDS = (
    "fields AS (SELECT request_id, 2 AS ord, 'subject' AS field, subject AS text FROM verdict WHERE reject_reason IS NULL "
    "UNION ALL SELECT request_id, 3, 'body', body FROM verdict WHERE reject_reason IS NULL)"
)
_K = "request_id, ord"
_FOUND = ", ".join(
    [
        O.folded("folded", "fields", _K),
        O.raw("auto_raw", "folded", _K),
        O.merged("auto_m", "auto_raw", _K),
        f"cred_raw AS ({O.rule('folded', _K, 'secret')} UNION ALL {O.assignments('folded', _K)})",
        O.merged("cred_m", "cred_raw", _K),
        "origins AS (SELECT request_id, ord, label, s, e, 'detector' AS origin FROM auto_m UNION ALL "
        "SELECT request_id, ord, label, s, e, 'credential_rule' FROM cred_m UNION ALL "
        "SELECT request_id, 3, 'manual', m_start, m_end, 'manual' FROM verdict WHERE masked AND reject_reason IS NULL UNION ALL "
        "SELECT request_id, 2, 'manual', 0, 5, 'manual' FROM verdict WHERE masked AND reject_reason IS NULL)",
        O.merged("final", "origins", _K),
        "named AS (SELECT f.*, substr(t.text, (s + 1)::bigint, (e - s)::bigint) AS match FROM final f JOIN fields t USING (request_id, ord))",
        "ident AS (SELECT request_id, label, match, min(ord * 100000 + s) AS first_pos FROM named GROUP BY ALL)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id, label ORDER BY first_pos) AS k FROM ident)",
        "slots AS (SELECT i.request_id, i.label, n.n, row_number() OVER (PARTITION BY i.request_id, i.label ORDER BY n.n) AS k "
        "FROM (SELECT request_id, label, count(*) AS c FROM ident GROUP BY ALL) i JOIN verdict v USING (request_id) "
        "JOIN range(1, 60) n(n) ON n.n <= i.c + 4 AND NOT contains(v.sender || v.recipients || v.subject || v.body, "
        "'[' || upper(i.label) || '_' || n.n || ']'))",
        "numbered AS (SELECT d.request_id, d.ord, d.label, d.s, d.e, '[' || upper(d.label) || '_' || sl.n || ']' AS placeholder "
        "FROM named d JOIN ranked r USING (request_id, label, match) JOIN slots sl ON sl.request_id = r.request_id "
        "AND sl.label = r.label AND sl.k = r.k)",
        "sources AS (SELECT n.request_id, n.ord, n.s, string_agg(DISTINCT o.origin, ',' ORDER BY o.origin) AS sources "
        "FROM numbered n JOIN origins o ON o.request_id = n.request_id AND o.ord = n.ord AND o.s < n.e AND o.e > n.s GROUP BY ALL)",
        "findings AS (SELECT n.request_id, CASE n.ord WHEN 2 THEN 'subject' ELSE 'body' END AS field, n.label, n.s, n.e, n.placeholder, "
        "x.sources FROM numbered n JOIN sources x ON x.request_id = n.request_id AND x.ord = n.ord AND x.s = n.s UNION ALL "
        "SELECT request_id, 'sender', 'private_email', 0, length(sender), '[SENDER_REMOVED]', 'routing_policy' FROM verdict WHERE reject_reason IS NULL UNION ALL "
        "SELECT request_id, 'recipients', 'private_email', 0, length(recipients), '[RECIPIENTS_REMOVED]', 'routing_policy' FROM verdict WHERE reject_reason IS NULL)",
        O.redacted("red", "fields", "numbered", ["request_id", "ord"], mark="placeholder"),
    ]
)
_BASE = O.with_(O.MESSAGES, _REQUESTS, _VERDICT)
_FULL = O.with_(O.MESSAGES, _REQUESTS, _VERDICT, _FIELDS, _FOUND)


QUERIES["d1_request_verdicts"] = lambda spark, folder: _prepared(spark, folder).select("request_id", "reject_reason")
ORACLE["d1_request_verdicts"] = _BASE + "SELECT request_id, reject_reason FROM verdict"

QUERIES["d2_candidate_fields"] = lambda spark, folder: P.accepted(_prepared(spark, folder)).selectExpr(
    "request_id", "stack(4, 0, 'sender', candidate_fields['sender'], 1, 'recipients', candidate_fields['recipients'], "
    "2, 'subject', candidate_fields['subject'], 3, 'body', candidate_fields['body']) AS (field_ord, field, text)"
)
ORACLE["d2_candidate_fields"] = (
    _FULL
    + "SELECT request_id, 0 AS field_ord, 'sender' AS field, '[SENDER_REMOVED]' AS text FROM verdict WHERE reject_reason IS NULL UNION ALL "
    "SELECT request_id, 1, 'recipients', '[RECIPIENTS_REMOVED]' FROM verdict WHERE reject_reason IS NULL UNION ALL "
    "SELECT request_id, ord, CASE ord WHEN 2 THEN 'subject' ELSE 'body' END, redacted FROM red"
)

QUERIES["d3_findings_by_origin"] = lambda spark, folder: (
    P.findings(_prepared(spark, folder)).groupBy("field", "label", F.array_join("sources", ",").alias("sources")).agg(F.count("*").alias("n"))
)
ORACLE["d3_findings_by_origin"] = _FULL + "SELECT field, label, sources, count(*) AS n FROM findings GROUP BY field, label, sources"


def d4_matching_masks(spark, folder):
    """Overlapping occurrences of a reviewer's text in every document."""
    docs = D.spread(Tables(spark, folder).read("documents").select("doc_id", "text"))
    masks = P.matching_masks("text", "'anan'")
    return docs.select("doc_id", F.explode(F.expr(masks)).alias("m")).select(
        "doc_id", F.col("m.start").cast("bigint").alias("start_at"), F.col("m.end").cast("bigint").alias("end_at")
    )


QUERIES["d4_matching_masks"] = d4_matching_masks
ORACLE["d4_matching_masks"] = (
    "SELECT doc_id, i - 1 AS start_at, i + 3 AS end_at FROM (SELECT doc_id, text, unnest(range(1, length(text) - 2)) AS i "
    "FROM documents WHERE contains(text, 'anan')) WHERE substr(text, i, 4) = 'anan'"
)


def d5_mask_union(spark, folder):
    """Masks of a reviewer's text added to masks already there, without repeats."""
    docs = D.spread(Tables(spark, folder).read("documents").select("doc_id", "text"))
    present = P.matching_masks("text", "'anan'")
    added = P.matching_masks("text", "'an'")
    return S.hold(docs, {"masks": P.add_masks(present, added)}).select(
        "doc_id", F.expr(f"size(masks) > {V.REQUEST_LIMITS['manual_masks']}").alias("many"), F.expr("cast(size(masks) AS bigint)").alias("n")
    )


QUERIES["d5_mask_union"] = d5_mask_union
ORACLE["d5_mask_union"] = (
    "SELECT doc_id, n > 128 AS many, n FROM (SELECT doc_id, "
    "len(list_filter(range(1, length(text)), lambda i: substr(text, i, 2) = 'an')) + "
    "len(list_filter(range(1, greatest(length(text) - 2, 1)), lambda i: substr(text, i, 4) = 'anan')) AS n FROM documents)"
)

QUERIES["d6_ticket_verdicts"] = lambda spark, folder: _tickets(spark, folder).select("request_id", "use_case", "reject_reason")
_DOC_FOUND = ", ".join(
    [
        "v AS (SELECT d.doc_id AS request_id, CASE d.doc_id % 3 WHEN 0 THEN 'ai_prompt' WHEN 1 THEN 'support_ticket' ELSE 'memo' END AS use_case, "
        "CASE WHEN d.doc_id % 3 = 2 THEN 'unknown_use_case' WHEN trim(text) = '' THEN 'input_empty' END AS reject_reason FROM documents d)",
    ]
)
ORACLE["d6_ticket_verdicts"] = O.with_(_DOC_FOUND) + "SELECT request_id, use_case, reject_reason FROM v"

QUERIES["d7_manual_unions"] = lambda spark, folder: (
    P.findings(_prepared(spark, folder)).where("array_contains(sources, 'manual')").select(
        "request_id", "field", "label", F.col("start").cast("bigint").alias("start_at"), F.col("end").cast("bigint").alias("end_at")
    )
)
ORACLE["d7_manual_unions"] = (
    _FULL + "SELECT request_id, field, label, s AS start_at, e AS end_at FROM findings WHERE contains(sources, 'manual')"
)

QUERIES["d8_numbered_findings"] = lambda spark, folder: P.findings(_prepared(spark, folder)).select(
    "request_id", "field", "label", F.col("start").cast("bigint").alias("start_at"),
    F.col("end").cast("bigint").alias("end_at"), "placeholder", F.array_join("sources", ",").alias("sources"),
)
ORACLE["d8_numbered_findings"] = (
    _FULL + "SELECT request_id, field, label, s AS start_at, e AS end_at, placeholder, sources FROM findings"
)


def d9_skipped_numbers(spark, folder):
    """Requests where number one of a label already stood in the text."""
    f = P.findings(_prepared(spark, folder)).where("label IN ('private_person', 'secret')")
    return f.groupBy("label", "placeholder").agg(F.count("*").alias("n"))


QUERIES["d9_skipped_numbers"] = d9_skipped_numbers
ORACLE["d9_skipped_numbers"] = (
    _FULL + "SELECT label, placeholder, count(*) AS n FROM findings WHERE label IN ('private_person', 'secret') GROUP BY label, placeholder"
)

QUERIES["d11_removed_headers"] = lambda spark, folder: (
    P.findings(_prepared(spark, folder)).where("array_contains(sources, 'routing_policy')").select(
        "request_id", "field", F.col("end").cast("bigint").alias("end_at"), "placeholder"
    )
)
ORACLE["d11_removed_headers"] = (
    _FULL + "SELECT request_id, field, e AS end_at, placeholder FROM findings WHERE sources = 'routing_policy'"
)

QUERIES["d12_routing_summaries"] = lambda spark, folder: P.accepted(_prepared(spark, folder)).selectExpr(
    "request_id", "cast(routing.recipient_count AS bigint) AS recipient_count", "routing.crosses_boundary", "routing.all_recipients_internal"
)
ORACLE["d12_routing_summaries"] = (
    _BASE
    + ", r AS (SELECT request_id, lower(split_part(sender, '@', -1)) AS sd, lower(split_part(unnest(rcpt), '@', -1)) AS d FROM verdict "
    f"WHERE reject_reason IS NULL) SELECT request_id, count(*) AS recipient_count, bool_or((d IN {O.INTERNAL}) <> (sd IN {O.INTERNAL})) AS crosses_boundary, "
    f"bool_and(d IN {O.INTERNAL}) AS all_recipients_internal FROM r GROUP BY request_id"
).replace(") , r AS", "), r AS")

QUERIES["d14_request_summaries"] = lambda spark, folder: P.accepted(_prepared(spark, folder)).select(
    "request_id", "span_count", "manual_mask_count", "policy_version", "engine",
    *[F.expr(f"coalesce(by_label['{k}'], 0L)").alias(k) for k in [*V.LABELS, V.MANUAL_LABEL]],
)
ORACLE["d14_request_summaries"] = (
    _FULL
    + "SELECT f.request_id, count(*) AS span_count, any_value(CASE WHEN v.masked THEN 2 ELSE 0 END)::bigint AS manual_mask_count, "
    f"'{V.POLICY_VERSION}' AS policy_version, 'heuristic' AS engine, "
    + ", ".join(f"count(*) FILTER (WHERE label = '{k}') AS {k}" for k in [*V.LABELS, V.MANUAL_LABEL])
    + " FROM findings f JOIN verdict v USING (request_id) GROUP BY f.request_id"
)


def d16_policy_coverage(spark, folder):
    """Credential ranges known from how a log was put together that the policy leaves open."""
    logs = Tables(spark, folder).logs()
    requests = D.spread(logs).select(
        F.col("event_id").alias("request_id"), F.lit("ai_prompt").alias("use_case"),
        F.expr("map('text', text)").alias("fields"), F.expr(f"cast(null AS {P.MASKS})").alias("manual_masks"),
    )
    covered = P.findings(P.prepare(requests)).select("request_id", "start", "end")
    expected = logs.where("credential_length > 0").selectExpr(
        "event_id AS request_id", "lead_length AS start", "lead_length + credential_length AS end"
    )
    gaps = P.uncovered_expected(expected, covered, ["request_id"])
    sides = gaps.selectExpr("1 AS gap", "0 AS due").unionAll(expected.selectExpr("0", "1"))
    return sides.agg(F.expr("count_if(gap = 1)").alias("gaps"), F.expr("count_if(due = 1)").alias("expected"))


QUERIES["d16_policy_coverage"] = d16_policy_coverage
ORACLE["d16_policy_coverage"] = f"WITH {O.LOGS} SELECT 0::bigint AS gaps, count(*) AS expected FROM logs WHERE credential_length > 0"

QUERIES["a9_reviewed_texts"] = lambda spark, folder: export_reviewed(_prepared(spark, folder))
ORACLE["a9_reviewed_texts"] = (
    _FULL
    + "SELECT s.request_id, 'Sender: [SENDER_REMOVED]' || chr(10) || chr(10) || 'Recipients: [RECIPIENTS_REMOVED]' || chr(10) || chr(10) || "
    "'Subject: ' || s.redacted || chr(10) || chr(10) || 'Body: ' || b.redacted AS reviewed_text FROM red s JOIN red b "
    "ON b.request_id = s.request_id AND s.ord = 2 AND b.ord = 3"
)


# Requests with a limit on text and masks: what goes beyond is named, nothing else changes.
QUERIES["d6_limit_flags"] = lambda spark, folder: P.prepare(
    _ticket_requests(spark, folder), limits={"text_chars": 2_000, "findings_per_field": 3, "manual_masks": 0}
).select("request_id", F.array_join("limit_flags", ",").alias("limit_flags"))
ORACLE["d6_limit_flags"] = (
    O.with_(
        _DOC_FOUND, O.folded("folded", "documents", "doc_id"), O.raw("found", "folded", "doc_id"), O.merged("spans", "found", "doc_id"),
        "n AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id)",
    )
    + "SELECT v.request_id, CASE WHEN v.reject_reason IS NULL THEN array_to_string(list_filter([CASE WHEN n.n > 3 THEN 'findings_per_field' END, "
    "CASE WHEN length(d.text) > 2000 THEN 'text_chars' END], lambda x: x IS NOT NULL), ',') END AS limit_flags "
    "FROM v JOIN documents d ON d.doc_id = v.request_id LEFT JOIN n ON n.doc_id = v.request_id"
)


def _request_lines(spark, folder):
    """Every document as a line of JSON, some of which are no request."""
    docs = Tables(spark, folder).read("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    request = "named_struct('request_id', cast(doc_id AS string), 'use_case', 'ai_prompt', 'fields', map('text', text))"
    line = (
        "CASE doc_id % 8 WHEN 1 THEN '{broken' "
        "WHEN 2 THEN to_json(named_struct('request_id', cast(doc_id AS string), 'use_case', 'ai_prompt', 'fields', map('text', text), 'extra', 1)) "
        "WHEN 3 THEN to_json(named_struct('request_id', doc_id, 'use_case', 'ai_prompt', 'fields', map('text', text))) "
        "WHEN 4 THEN to_json(named_struct('request_id', cast(doc_id AS string), 'use_case', 'ai_prompt', 'fields', map('text', text), "
        "'manual_masks', array(named_struct('field', 'text', 'start', doc_id % 3 = 0, 'end', 1)))) "
        "WHEN 5 THEN to_json(named_struct('request_id', cast(doc_id AS string), 'use_case', 'ai_prompt', 'fields', map('text', text), "
        "'manual_masks', array(named_struct('field', 'text', 'start', doc_id % 5, 'end', doc_id % 5 + 4)))) "
        f"ELSE to_json({request}) END"
    )
    out = scratch_folder(spark, "requests")
    docs.select(F.expr(line).alias("value")).write.text(out)
    return Q.read_prepare_requests(spark, out)


QUERIES["d1_loaded_requests"] = lambda spark, folder: Q.accepted(_request_lines(spark, folder)).select(
    "request_id", "use_case", F.expr("length(fields['text'])").cast("bigint").alias("chars"),
    F.expr("coalesce(cast(get(manual_masks, 0).end AS bigint), 0L)").alias("mask_end"),
)
ORACLE["d1_loaded_requests"] = (
    "SELECT doc_id::varchar AS request_id, 'ai_prompt' AS use_case, length(coalesce(text, '')) AS chars, "
    "CASE WHEN doc_id % 8 = 5 THEN doc_id % 5 + 4 ELSE 0 END AS mask_end FROM documents WHERE doc_id % 8 IN (0, 5, 6, 7)"
)
QUERIES["d1_refused_requests"] = lambda spark, folder: Q.refused(_request_lines(spark, folder)).groupBy("refused").agg(F.count("*").alias("n"))
ORACLE["d1_refused_requests"] = (
    "SELECT ['not_json', 'unknown_field: request', 'wrong_type: request_id', 'wrong_type: manual_masks'][(doc_id % 8)::int] AS refused, "
    "count(*) AS n FROM documents WHERE doc_id % 8 BETWEEN 1 AND 4 GROUP BY 1"
)
