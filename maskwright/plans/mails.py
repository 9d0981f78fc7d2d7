"""Message queries: classification, scan, risk, directory, dashboard, views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright import fixed_values as V
from maskwright.operators import dashboard as B
from maskwright.operators import detect as D
from maskwright.operators import directory as P
from maskwright.operators import mail as M
from maskwright.plans import oracle as O
from maskwright.sources.tables import INTERNAL_DOMAINS, Tables

QUERIES = {}
ORACLE = {}


def _messages(spark, folder) -> DataFrame:
    return Tables(spark, folder).messages(D.spread)


def _classified(spark, folder) -> DataFrame:
    return M.classify(_messages(spark, folder), INTERNAL_DOMAINS)


def _assessed(spark, folder) -> DataFrame:
    return M.scan_all(_messages(spark, folder), INTERNAL_DOMAINS)


# --- reference SQL, in relational form: recipients and spans as rows ---

_DOMAIN = "CASE WHEN contains({a}, '@') THEN lower(split_part({a}, '@', -1)) ELSE '' END"
_CLASSIFIED = (
    f"rcpt AS (SELECT message_id, {_DOMAIN.format(a='r')} AS d FROM "
    "(SELECT message_id, unnest(recipients) AS r FROM messages)), "
    f"side AS (SELECT message_id, {_DOMAIN.format(a='sender')} AS sd FROM messages), "
    f"classified AS (SELECT s.message_id, any_value(sd) AS sender_domain, any_value(sd) IN {O.INTERNAL} AS sender_internal, "
    f"coalesce(bool_and(d IN {O.INTERNAL}), false) AS all_recipients_internal, "
    f"coalesce(bool_or(d IN {O.INTERNAL}), false) AS any_recipient_internal, "
    f"coalesce(bool_or((d IN {O.INTERNAL}) <> (sd IN {O.INTERNAL})), false) AS crosses_boundary "
    "FROM side s LEFT JOIN rcpt r ON r.message_id = s.message_id GROUP BY s.message_id)"
)
_PARTS = (
    "parts AS (SELECT message_id, 'body' AS part, body AS text FROM messages UNION ALL "
    "SELECT message_id, 'subject', subject FROM messages)"
)
_SPANS = ", ".join(
    [
        _PARTS,
        O.folded("folded", "parts", "message_id, part"),
        O.raw("found", "folded", "message_id, part"),
        O.merged("spans", "found", "message_id, part"),
    ]
)
_COUNTS = ", ".join(f"count(*) FILTER (WHERE label = '{k}') AS {k}" for k in V.LABELS)
_ASSESSED = (
    f"tally AS (SELECT message_id, count(*) AS span_count, {_COUNTS} FROM spans GROUP BY message_id), "
    "assessed AS (SELECT m.message_id, m.direction, m.sent_at, m.subject, m.sender, m.recipients, "
    "coalesce(t.span_count, 0) AS span_count, t.span_count IS NOT NULL AS is_sensitive, "
    + ", ".join(f"coalesce({k}, 0) AS {k}" for k in V.LABELS)
    + ", c.crosses_boundary, c.all_recipients_internal, t.span_count IS NOT NULL AND direction = 'outbound' "
    "AND NOT c.all_recipients_internal AS leak_risk FROM messages m JOIN classified c USING (message_id) "
    "LEFT JOIN tally t USING (message_id))"
)
MAIL = O.with_(O.MESSAGES, _CLASSIFIED)
SCANNED = O.with_(O.MESSAGES, _CLASSIFIED, _SPANS, _ASSESSED)


# --- E: classification ---


def e1_address_domains(spark, folder):
    m = _messages(spark, folder)
    return (
        m.select(F.explode(F.expr("concat(array(sender), recipients)")).alias("a"))
        .groupBy(F.expr(M.domain_of("a")).alias("domain"))
        .agg(F.count("*").alias("n"))
    )


QUERIES["e1_address_domains"] = e1_address_domains
ORACLE["e1_address_domains"] = (
    O.with_(O.MESSAGES)
    + f"SELECT {_DOMAIN.format(a='a')} AS domain, count(*) AS n FROM (SELECT sender AS a FROM messages "
    "UNION ALL SELECT unnest(recipients) FROM messages) GROUP BY 1"
)


def _flags(*names):
    def query(spark, folder):
        return _classified(spark, folder).select("message_id", *names)

    return query


for _key, _names in [
    ("e2_sender_internal", ["sender_domain", "sender_internal"]),
    ("e3_recipient_sides", ["all_recipients_internal", "any_recipient_internal"]),
    ("e6_crosses_boundary", ["crosses_boundary"]),
]:
    QUERIES[_key] = _flags(*_names)
    ORACLE[_key] = MAIL + f"SELECT message_id, {', '.join(_names)} FROM classified"

QUERIES["e4_external_domains"] = lambda spark, folder: _classified(spark, folder).select(
    "message_id", F.array_join("external_domains", ",").alias("external_domains")
)
ORACLE["e4_external_domains"] = (
    MAIL
    + "SELECT message_id, coalesce(string_agg(d, ',' ORDER BY d), '') AS external_domains FROM messages "
    f"LEFT JOIN (SELECT message_id, d FROM rcpt WHERE d NOT IN {O.INTERNAL} UNION "
    f"SELECT message_id, sd FROM side WHERE sd NOT IN {O.INTERNAL}) USING (message_id) GROUP BY message_id"
)
QUERIES["e5_fully_internal"] = _flags("fully_internal")
ORACLE["e5_fully_internal"] = (
    MAIL + "SELECT message_id, sender_internal AND all_recipients_internal AS fully_internal FROM classified"
)


def _nations(spark, folder) -> DataFrame:
    """A small directory: one clerk per nation."""
    return Tables(spark, folder).read("nation").selectExpr(
        "n_nationkey AS staff_ord", "n_name AS name",
        "'nation.' || n_nationkey || '@nation' || n_nationkey || '.example.com' AS email",
        "'region ' || n_regionkey AS role",
    )


def _suppliers(spark, folder) -> DataFrame:
    """A directory that grows with the data."""
    return Tables(spark, folder).read("supplier").selectExpr(
        "s_suppkey AS staff_ord", "s_name AS name",
        "'supplier.' || s_suppkey || '@nation' || s_nationkey || '.example.com' AS email",
        "'supplier' AS role",
    )


_NATIONS = (
    "staff AS (SELECT n_nationkey AS staff_ord, n_name AS name, 'nation.' || n_nationkey || '@nation' || "
    "n_nationkey || '.example.com' AS email, 'region ' || n_regionkey AS role FROM nation)"
)
_SUPPLIERS = (
    "staff AS (SELECT s_suppkey AS staff_ord, s_name AS name, 'supplier.' || s_suppkey || '@nation' || "
    "s_nationkey || '.example.com' AS email, 'supplier' AS role FROM supplier)"
)
_HITS = (
    "needles AS (SELECT staff_ord, name, role, 'name' AS kind, name AS needle FROM staff UNION ALL "
    "SELECT staff_ord, name, role, 'email', email FROM staff), "
    "hits AS (SELECT message_id, staff_ord, name AS employee, role, kind, "
    "strpos(lower(t), lower(needle)) - 1 AS s, length(needle) AS n, t FROM "
    "(SELECT message_id, body || ' ' || subject AS t FROM messages) JOIN needles ON contains(lower(t), lower(needle)))"
)


def _shuffled_mentions(spark, folder):
    """The suppliers by the route of a directory too large to broadcast."""
    texts = _messages(spark, folder).select("message_id", F.expr("concat(body, ' ', subject)").alias("_text"))
    return P.by_fragment(texts, _suppliers(spark, folder), small=False).select("message_id", F.col("name").alias("employee"), "kind", F.col("start").cast("bigint").alias("start_at"))


def _mention_query(directory):
    def query(spark, folder):
        found = P.mentions(_messages(spark, folder), directory(spark, folder))
        return found.select(
            "message_id", "employee", "role", "kind", F.col("start").cast("bigint").alias("start_at"),
            F.col("end").cast("bigint").alias("end_at"), "match_text",
        )

    return query


for _key, _dir, _cte in [
    ("e7_staff_mentions", _nations, _NATIONS),
    ("e7_directory_mentions", _suppliers, _SUPPLIERS),
]:
    QUERIES[_key] = _mention_query(_dir)
    ORACLE[_key] = (
        O.with_(O.MESSAGES, _cte, _HITS)
        + "SELECT message_id, employee, role, kind, s AS start_at, s + n AS end_at, substr(t, s + 1, n) AS match_text FROM hits"
    )

QUERIES["e7_shuffled_mentions"] = _shuffled_mentions
ORACLE["e7_shuffled_mentions"] = O.with_(O.MESSAGES, _SUPPLIERS, _HITS) + "SELECT message_id, employee, kind, s AS start_at FROM hits"

QUERIES["e8_mentions_per_person"] = lambda spark, folder: P.fold_mentions(
    P.mentions(_messages(spark, folder), _nations(spark, folder))
).select("message_id", "employee", "role", F.array_join("kinds", ",").alias("kinds"))
ORACLE["e8_mentions_per_person"] = (
    O.with_(O.MESSAGES, _NATIONS, _HITS)
    + "SELECT message_id, employee, role, string_agg(kind, ',' ORDER BY kind) AS kinds FROM hits "
    "GROUP BY message_id, staff_ord, employee, role"
)


def e9_message_scan(spark, folder):
    return _assessed(spark, folder).select(
        "message_id", "span_count", "is_sensitive",
        *[F.expr(f"coalesce(by_label['{k}'], 0L)").alias(k) for k in V.LABELS],
    )


QUERIES["e9_message_scan"] = e9_message_scan
ORACLE["e9_message_scan"] = (
    SCANNED + f"SELECT message_id, span_count, is_sensitive, {', '.join(V.LABELS)} FROM assessed"
)

QUERIES["e10_leak_risk"] = lambda spark, folder: _assessed(spark, folder).select("message_id", "leak_risk")
ORACLE["e10_leak_risk"] = SCANNED + "SELECT message_id, leak_risk FROM assessed"

_RISK = "CASE WHEN leak_risk THEN 'Risk' WHEN is_sensitive THEN 'Sensitive' ELSE 'No findings' END"
QUERIES["e11_risk_tiers"] = lambda spark, folder: (
    _assessed(spark, folder).groupBy("direction", "risk").agg(F.count("*").alias("n"))
)
ORACLE["e11_risk_tiers"] = SCANNED + f"SELECT direction, {_RISK} AS risk, count(*) AS n FROM assessed GROUP BY 1, 2"

QUERIES["e12_priority_labels"] = lambda spark, folder: _assessed(spark, folder).select(
    "message_id", F.array_join("labels_by_priority", ",").alias("labels"), "top_label"
)
_RANKED = "concat_ws(',', " + ", ".join(f"CASE WHEN {k} > 0 THEN '{k}' END" for k in V.LABEL_ORDER) + ")"
_TOP = "CASE " + " ".join(f"WHEN {k} > 0 THEN '{k}'" for k in V.LABEL_ORDER) + " ELSE 'secret' END"
ORACLE["e12_priority_labels"] = SCANNED + f"SELECT message_id, {_RANKED} AS labels, {_TOP} AS top_label FROM assessed"


def e13_display_names(spark, folder):
    m = _messages(spark, folder).select("message_id", "sender", F.expr("concat(sender, ' via ', subject)").alias("a"))
    return m.select(
        "message_id", F.expr(M.display_name("sender")).alias("display_name"), F.expr(M.shorten("a")).alias("shortened")
    )


QUERIES["e13_display_names"] = e13_display_names
ORACLE["e13_display_names"] = (
    O.with_(O.MESSAGES)
    + "SELECT message_id, array_to_string(list_transform(string_split_regex(split_part(sender, '@', 1), '[._-]'), "
    "lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS display_name, "
    "CASE WHEN length(sender || ' via ' || subject) > 38 THEN substr(sender || ' via ' || subject, 1, 36) || '…' "
    "ELSE sender || ' via ' || subject END AS shortened FROM messages"
)


def e14_scan_coverage(spark, folder):
    """Messages not scanned exactly once: none, over the whole scan."""
    return M.coverage_gaps(_messages(spark, folder), _assessed(spark, folder))


QUERIES["e14_scan_coverage"] = e14_scan_coverage
ORACLE["e14_scan_coverage"] = (
    O.with_(O.MESSAGES)
    + "SELECT message_id, count(*) AS expected, cast(0 AS bigint) AS scanned FROM messages GROUP BY message_id HAVING count(*) <> 1"
)


# --- F: dashboard ---

_COUNTER_SQL = ", ".join(f"count(*) FILTER (WHERE {cond}) AS {name}" for name, cond in B.COUNTERS.items())

QUERIES["f1_counters"] = lambda spark, folder: B.counters(_assessed(spark, folder))
ORACLE["f1_counters"] = SCANNED + f"SELECT {_COUNTER_SQL} FROM assessed"

QUERIES["f2_label_totals"] = lambda spark, folder: B.label_totals(_assessed(spark, folder))
ORACLE["f2_label_totals"] = SCANNED + "SELECT label, count(*) AS n FROM spans GROUP BY label"

QUERIES["f3_kpis"] = lambda spark, folder: B.kpis(_assessed(spark, folder))
ORACLE["f3_kpis"] = (
    SCANNED
    + "SELECT count(*) AS total, count(*) FILTER (WHERE is_sensitive) AS sensitive, "
    "count(*) FILTER (WHERE leak_risk) AS leaks_out, "
    "count(*) FILTER (WHERE is_sensitive AND direction = 'inbound') AS sensitive_inbound, "
    "count(*) FILTER (WHERE crosses_boundary) AS crossing_boundary, cast(sum(span_count) AS bigint) AS spans, "
    "(SELECT count(DISTINCT label) FROM spans) AS categories, "
    "cast(floor(100.0 * count(*) FILTER (WHERE is_sensitive) / count(*) + 0.5) AS bigint) AS sensitive_percent FROM assessed"
)

QUERIES["f4_splits"] = lambda spark, folder: B.splits(B.counters(_assessed(spark, folder)))
ORACLE["f4_splits"] = (
    SCANNED
    + f", c AS (SELECT {_COUNTER_SQL} FROM assessed) SELECT 'sensitive' AS split, sensitive AS left_count, "
    "total - sensitive AS right_count FROM c UNION ALL SELECT 'leaks', leaks_out, outbound - leaks_out FROM c "
    "UNION ALL SELECT 'inside', total - crossing_boundary, crossing_boundary FROM c"
).replace(") , c AS", "), c AS")

QUERIES["f5_label_bars"] = lambda spark, folder: B.label_bars(B.label_totals(_assessed(spark, folder))).select(
    "label", "n", F.round("width", 6).alias("width")
)
ORACLE["f5_label_bars"] = (
    SCANNED
    + "SELECT label, n, round(100.0 * n / greatest(1, max(n) OVER ()), 6)::double AS width FROM (SELECT l.label, count(s.s) AS n "
    "FROM (VALUES " + ", ".join(f"('{k}')" for k in V.LABELS) + ") l(label) LEFT JOIN spans s ON s.label = l.label GROUP BY l.label)"
)

QUERIES["f6_direction_by_label"] = lambda spark, folder: B.crosstab(_assessed(spark, folder))
ORACLE["f6_direction_by_label"] = (
    SCANNED
    + "SELECT coalesce(direction, '*') AS direction, coalesce(label, '*') AS label, count(*) AS n FROM spans "
    "JOIN messages USING (message_id) GROUP BY CUBE (direction, label)"
)

QUERIES["f7_running_counters"] = lambda spark, folder: B.running_counters(_assessed(spark, folder)).withColumnRenamed(
    "instant", "sent_at"
)
ORACLE["f7_running_counters"] = (
    SCANNED
    + "SELECT sent_at, "
    + ", ".join(f"cast(sum(sum(({cond})::int)) OVER w AS bigint) AS {name}" for name, cond in B.COUNTERS.items())
    + ", cast(sum(sum(span_count)) OVER w AS bigint) AS spans FROM assessed GROUP BY sent_at WINDOW w AS (ORDER BY sent_at)"
)


# --- G: views and listings ---


def g1_views(spark, folder):
    """Rows shown by each view, an unknown name included."""
    df = _assessed(spark, folder)
    names = [*M.VIEWS, "unheard-of"]
    counts = df.agg(*[F.count_if(F.expr(M.VIEWS.get(n, M.VIEWS["all"]))).alias(f"v{i}") for i, n in enumerate(names)])
    pairs = ", ".join(f"'{n}', v{i}" for i, n in enumerate(names))
    return counts.selectExpr(f"stack({len(names)}, {pairs}) AS (view, n)")


QUERIES["g1_views"] = g1_views
ORACLE["g1_views"] = SCANNED + " UNION ALL ".join(
    f"SELECT '{n}' AS view, count(*) FILTER (WHERE {c}) AS n FROM assessed"
    for n, c in [*M.VIEWS.items(), ("unheard-of", "true")]
)

QUERIES["g1_leak_view"] = lambda spark, folder: M.view(_assessed(spark, folder), "leaks").select(
    "message_id", "span_count", "top_label"
)
ORACLE["g1_leak_view"] = SCANNED + f"SELECT message_id, span_count, {_TOP} AS top_label FROM assessed WHERE leak_risk"

QUERIES["g2_message_by_id"] = lambda spark, folder: M.by_id(_assessed(spark, folder), 7).select(
    "message_id", "subject", "body", "subject_redacted", "body_redacted", "span_count"
)
ORACLE["g2_message_by_id"] = (
    O.with_(
        O.MESSAGES, _CLASSIFIED, _SPANS, _ASSESSED,
        "ps AS (SELECT message_id, part, text FROM parts)", O.redacted("r", "ps", "spans", ["message_id", "part"]),
    )
    + "SELECT m.message_id, m.subject, m.body, s.redacted AS subject_redacted, b.redacted AS body_redacted, a.span_count "
    "FROM messages m JOIN assessed a USING (message_id) JOIN r s ON s.message_id = m.message_id AND s.part = 'subject' "
    "JOIN r b ON b.message_id = m.message_id AND b.part = 'body' WHERE m.message_id = 7"
)

QUERIES["g3_newest_first"] = lambda spark, folder: M.newest_first(_assessed(spark, folder)).select(
    "message_id", "sent_at", "risk"
)
ORACLE["g3_newest_first"] = SCANNED + f"SELECT message_id, sent_at, {_RISK} AS risk FROM assessed ORDER BY sent_at DESC, message_id DESC"
