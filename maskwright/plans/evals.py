"""Evaluation queries: the detector scored against planted values of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright import fixed_values as V
from maskwright.functions import spans as S
from maskwright.operators import credentials as C
from maskwright.operators import detect as D
from maskwright.operators import evaluate as E
from maskwright.operators import prepare as P
from maskwright.operators import review as R
from maskwright.plans import oracle as O
from maskwright.plans import prepares as PP
from maskwright.sources.labelled import gate, rows_digest, stamp, write_report_folder
from maskwright.sources.scratch import scratch_folder, written
from maskwright.sources.tables import Tables

QUERIES = {}
ORACLE = {}

# Exact shapes of planted values serve as labels.
_GOLD = [
    ("private_email", r"[a-z]+\.[0-9]{2}@mail[0-9]\.example\.com"),
    ("secret", r"[0-9a-f]{40}"),
    ("private_phone", r"\([0-9]{3}\) 555-[0-9]{4}"),
    ("account_number", r"[0-9]{16}"),
]
_GOLD_SPANS = "concat(" + ", ".join(S.find_all("text", p, k) for k, p in _GOLD) + ")"
_GOLD_CTE = "gold AS (" + " UNION ALL ".join(O._all_matches("folded", "doc_id", p, k) for k, p in _GOLD) + ")"
_KEYS = ["true_positives", "false_positives", "false_negatives"]
_CHARS = ["sensitive_characters", "unredacted_sensitive_characters", "extra_redacted_characters"]
DIGEST = "planted-values"


def _cases(spark, folder) -> DataFrame:
    docs = Tables(spark, folder).read("documents").select("doc_id", "text", "lang", "source")
    return S.hold(
        D.spread(docs).select(F.col("doc_id").alias("case_id"), "text", F.array("lang", "source").alias("groups")),
        {"gold": _GOLD_SPANS},
    )


def _scored(spark, folder) -> DataFrame:
    return E.score(D.detect(_cases(spark, folder)))


_BASE = ", ".join(
    [
        O.folded("folded", "documents", "doc_id"), O.raw("found", "folded", "doc_id"),
        O.merged("spans", "found", "doc_id"), _GOLD_CTE,
    ]
)


def _score_ctes(pred: str, out: str) -> str:
    """Exact matches by full outer join, characters one by one."""
    return (
        f"{out}_x AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, coalesce(g.label, p.label) AS label, "
        f"g.s IS NOT NULL AS in_gold, p.s IS NOT NULL AS in_pred FROM (SELECT DISTINCT doc_id, label, s, e FROM gold) g "
        f"FULL JOIN (SELECT DISTINCT doc_id, label, s, e FROM {pred}) p ON g.doc_id = p.doc_id AND g.label = p.label AND g.s = p.s AND g.e = p.e), "
        f"{out}_gc AS (SELECT DISTINCT doc_id, unnest(range(s::bigint, e::bigint)) AS c FROM gold), "
        f"{out}_pc AS (SELECT DISTINCT doc_id, unnest(range(s::bigint, e::bigint)) AS c FROM {pred}), "
        f"{out}_ch AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, count(g.c) AS sens, "
        f"count(*) FILTER (WHERE p.c IS NULL) AS missed, count(*) FILTER (WHERE g.c IS NULL) AS extra "
        f"FROM {out}_gc g FULL JOIN {out}_pc p ON g.doc_id = p.doc_id AND g.c = p.c GROUP BY 1), "
        f"{out}_t AS (SELECT doc_id, count(*) FILTER (WHERE in_gold AND in_pred) AS tp, count(*) FILTER (WHERE NOT in_gold) AS fp, "
        f"count(*) FILTER (WHERE NOT in_pred) AS fn FROM {out}_x GROUP BY doc_id), "
        f"{out} AS (SELECT d.doc_id AS case_id, d.lang, d.source, coalesce(tp, 0) AS true_positives, coalesce(fp, 0) AS false_positives, "
        f"coalesce(fn, 0) AS false_negatives, coalesce(sens, 0) AS sensitive_characters, coalesce(missed, 0) AS unredacted_sensitive_characters, "
        f"coalesce(extra, 0) AS extra_redacted_characters FROM documents d LEFT JOIN {out}_t t USING (doc_id) LEFT JOIN {out}_ch c USING (doc_id))"
    )


_RATIOS = (
    "round(true_positives / nullif(true_positives + false_positives, 0), 6) AS precision, "
    "round(true_positives / nullif(true_positives + false_negatives, 0), 6) AS recall"
)
_SUMS = ", ".join(f"cast(sum({c}) AS bigint) AS {c}" for c in [*_KEYS, *_CHARS])
SCORED = O.with_(_BASE, _score_ctes("spans", "scored"))


QUERIES["i1_case_report"] = lambda spark, folder: E.case_rows(_scored(spark, folder))
ORACLE["i1_case_report"] = SCORED + f"SELECT case_id, {', '.join(_KEYS + _CHARS)}, {_RATIOS} FROM scored"

QUERIES["i4_by_label"] = lambda spark, folder: E.by_label(_scored(spark, folder))
ORACLE["i4_by_label"] = (
    SCORED
    + f"SELECT *, {_RATIOS} FROM (SELECT l.label, count(*) FILTER (WHERE in_gold AND in_pred) AS true_positives, "
    "count(*) FILTER (WHERE NOT in_gold) AS false_positives, count(*) FILTER (WHERE NOT in_pred) AS false_negatives FROM (VALUES "
    + ", ".join(f"('{k}')" for k in V.LABELS)
    + ") l(label) LEFT JOIN scored_x x ON x.label = l.label GROUP BY l.label)"
)

QUERIES["i5_totals"] = lambda spark, folder: E.totals(_scored(spark, folder))
_COVER = (
    "round((sensitive_characters - unredacted_sensitive_characters) / nullif(sensitive_characters, 0), 6) AS sensitive_character_coverage"
)
ORACLE["i5_totals"] = SCORED + f"SELECT *, {_RATIOS}, {_COVER} FROM (SELECT count(*) AS case_count, {_SUMS} FROM scored)"

QUERIES["i6_by_group"] = lambda spark, folder: E.by_group(_scored(spark, folder))
ORACLE["i6_by_group"] = (
    SCORED
    + f"SELECT *, {_RATIOS} FROM (SELECT \"group\", count(*) AS case_count, {_SUMS} FROM (SELECT lang AS \"group\", * FROM scored "
    "UNION ALL SELECT source, * FROM scored) GROUP BY \"group\")"
)


def i7_integrity(spark, folder):
    """Every tenth result claims spans it did not mask; another tenth runs past the end of its text."""
    done = D.detect(_cases(spark, folder))
    past = "transform(spans, (s, i) -> named_struct('start', s.start, 'end', s.end + length(text), 'label', s.label))"
    broken = S.hold(
        done,
        {
            "redacted_text": "CASE WHEN case_id % 10 = 0 THEN text ELSE redacted_text END",
            "spans": f"CASE WHEN case_id % 10 = 1 THEN {past} ELSE spans END",
        },
    )
    return E.integrity_errors(broken)


QUERIES["i7_integrity"] = i7_integrity
ORACLE["i7_integrity"] = (
    O.with_(_BASE)
    + "SELECT DISTINCT doc_id AS case_id, CASE WHEN doc_id % 10 = 0 THEN 'redaction_mismatch' ELSE 'invalid_span' END AS error "
    "FROM spans WHERE doc_id % 10 < 2"
)


def _policy_scored(spark, folder) -> DataFrame:
    """The credential policy alone, scored as an engine of its own."""
    cases = S.hold(_cases(spark, folder), {"own": C.credential_spans("text")})
    return E.score(D.detect(cases, raw="own").withColumn("engine", F.lit("credential_policy")))


QUERIES["i8_mixed_engines"] = lambda spark, folder: E.mixed_engines(
    _scored(spark, folder).where("size(spans) = 0").unionByName(_policy_scored(spark, folder).where("false_negatives > 0"))
)
_CREDS = O.merged("creds", "cred_raw", "doc_id")
_CRED_RAW = f"cred_raw AS ({O.rule('folded', 'doc_id', 'secret')} UNION ALL {O.assignments('folded', 'doc_id')})"
ORACLE["i8_mixed_engines"] = (
    O.with_(
        _BASE, _CRED_RAW, _CREDS, _score_ctes("creds", "policy"),
        "e AS (SELECT 'heuristic' AS engine, count(*) AS cases FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM spans) "
        "UNION ALL SELECT 'credential_policy', count(*) FROM policy WHERE false_negatives > 0)",
    )
    + "SELECT engine, cases FROM (SELECT *, count(*) OVER () AS engines FROM e WHERE cases > 0) WHERE engines > 1"
)

QUERIES["i12_compare_engines"] = lambda spark, folder: E.compare_engines(
    _scored(spark, folder).unionByName(_policy_scored(spark, folder))
)
ORACLE["i12_compare_engines"] = (
    O.with_(
        _BASE, _score_ctes("spans", "scored"),
        _CRED_RAW, _CREDS, _score_ctes("creds", "policy"),
    )
    + f"SELECT *, {_RATIOS} FROM (SELECT 'heuristic' AS engine, count(*) AS case_count, {_SUMS} FROM scored UNION ALL "
    f"SELECT 'credential_policy', count(*), {_SUMS} FROM policy)"
)


def _dataset(spark, folder) -> DataFrame:
    """Documents as labelled cases, line by line, with some mistakes planted."""
    docs = Tables(spark, folder).read("documents").select("doc_id", "text", "lang", "source")
    label = (
        "CASE WHEN contains(x, '@') THEN CASE WHEN doc_id % 13 = 0 THEN 'invented' ELSE 'private_email' END "
        "WHEN contains(x, 'token') THEN 'secret' END"
    )
    return D.spread(docs).select(
        F.expr("CASE WHEN doc_id % 50 = 0 THEN 'same' ELSE 'd' || doc_id END").alias("case_id"),
        "doc_id",
        F.expr("CASE WHEN doc_id % 11 = 0 THEN array(lang, 'Bad Name') WHEN doc_id % 7 = 0 THEN array(lang, lang) ELSE array(lang, source) END").alias("groups"),
        F.expr(
            f"concat(transform(split(text, '\\n', -1), x -> named_struct('label', {label}, 'text', x || '\\n')), "
            "CASE WHEN doc_id % 17 = 0 THEN array(named_struct('label', 'secret', 'text', '')) ELSE "
            "cast(array() AS array<struct<label:string,text:string>>) END)"
        ).alias("segments"),
    )


QUERIES["i9_dataset_errors"] = lambda spark, folder: E.dataset_errors(_dataset(spark, folder).drop("doc_id"))
ORACLE["i9_dataset_errors"] = (
    "WITH c AS (SELECT CASE WHEN doc_id % 50 = 0 THEN 'same' ELSE 'd' || doc_id END AS case_id, "
    "CASE WHEN doc_id % 13 = 0 AND contains(text, '@') THEN 'unknown_label' WHEN doc_id % 17 = 0 THEN 'empty_annotation' "
    "WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 THEN 'invalid_groups' END AS error FROM documents) "
    "SELECT case_id, error FROM c WHERE error IS NOT NULL UNION ALL SELECT case_id, 'duplicate_id' FROM c GROUP BY case_id HAVING count(*) > 1"
)

QUERIES["a4_assembled_gold"] = lambda spark, folder: (
    E.assemble(_dataset(spark, folder)).select("doc_id", F.length("text").cast("bigint").alias("text_length"), F.explode("gold").alias("s")).select(
        "doc_id", "text_length", F.col("s.label").alias("label"), F.col("s.start").cast("bigint").alias("start_at"), F.col("s.end").cast("bigint").alias("end_at")
    )
)
ORACLE["a4_assembled_gold"] = (
    "WITH l AS (SELECT doc_id, length(text) + 1 AS text_length, unnest(string_split(text, chr(10))) || chr(10) AS x, "
    "generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), "
    "o AS (SELECT *, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM l), "
    "g AS (SELECT doc_id, text_length, CASE WHEN contains(x, '@') THEN CASE WHEN doc_id % 13 = 0 THEN 'invented' ELSE 'private_email' END "
    "WHEN contains(x, 'token') THEN 'secret' END AS label, e - length(x) AS s, e FROM o "
    "UNION ALL SELECT doc_id, length(text) + 1, 'secret', length(text) + 1, length(text) + 1 FROM documents WHERE doc_id % 17 = 0) "
    "SELECT doc_id, text_length, label, cast(s AS bigint) AS start_at, cast(e AS bigint) AS end_at FROM g WHERE label IS NOT NULL"
)


def _gate(spark, folder, older):
    """A report, stored once, against an older one made from it."""
    report = written(E.case_rows(_scored(spark, folder)), "report")
    found = E.regressions(stamp(report, "heuristic", DIGEST), stamp(older(report), "heuristic", DIGEST))
    return found.select("case_id", F.col("check").alias("measure"), "was", "now")


def _lower_counts(report: DataFrame) -> DataFrame:
    """Some counts lower, some higher."""
    return report.withColumns(
        {
            "false_positives": F.expr("CASE WHEN case_id % 4 = 0 THEN greatest(false_positives - 1, 0L) ELSE false_positives + 1 END"),
            "extra_redacted_characters": F.expr("CASE WHEN case_id % 6 = 0 THEN extra_redacted_characters - 1 ELSE extra_redacted_characters END"),
        }
    )


QUERIES["i10_regressions"] = lambda spark, folder: _gate(spark, folder, _lower_counts)
ORACLE["i10_regressions"] = (
    SCORED
    + "SELECT case_id, 'false_positives' AS measure, false_positives - 1 AS was, false_positives AS now FROM scored "
    "WHERE case_id % 4 = 0 AND false_positives > 0 UNION ALL "
    "SELECT case_id, 'extra_redacted_characters', extra_redacted_characters - 1, extra_redacted_characters FROM scored WHERE case_id % 6 = 0"
)

# Cases without a gold span are new to the report: the comparison ends there, although counts rose as well.
QUERIES["i10_new_cases"] = lambda spark, folder: _gate(
    spark, folder, lambda report: _lower_counts(report).where("true_positives + false_negatives > 0")
)
ORACLE["i10_new_cases"] = (
    SCORED
    + "SELECT case_id, 'case_ids' AS measure, cast(NULL AS bigint) AS was, cast(1 AS bigint) AS now FROM scored "
    "WHERE true_positives + false_negatives = 0"
)


def i10_stored_gate(spark, folder):
    """Two whole reports as files, the older with other counts, compared from their paths."""
    scored = written(_scored(spark, folder).drop("text", "redacted_text"), "scored")
    paths = [scratch_folder(spark, name) for name in ("report", "baseline")]
    for path, rows in zip(paths, (scored, _lower_counts(scored)), strict=True):
        write_report_folder(rows, path, engine="heuristic", digest=DIGEST)
    return gate(spark, *paths).select("case_id", F.col("check").alias("measure"), "was", "now")


QUERIES["i10_stored_gate"] = i10_stored_gate
ORACLE["i10_stored_gate"] = ORACLE["i10_regressions"]

# Refused sides: no cases, and cases that are repeated. Both would compare as equal, row by row.
QUERIES["i10_empty_reports"] = lambda spark, folder: _gate(spark, folder, lambda report: report.where("false"))
ORACLE["i10_empty_reports"] = "SELECT cast(NULL AS bigint) AS case_id, 'no_cases' AS measure, cast(NULL AS bigint) AS was, cast(NULL AS bigint) AS now"
QUERIES["i10_repeated_cases"] = lambda spark, folder: _gate(spark, folder, lambda report: report.unionAll(report.where("case_id % 9 = 0")))
ORACLE["i10_repeated_cases"] = (
    "SELECT doc_id AS case_id, 'repeated_ids' AS measure, cast(2 AS bigint) AS was, cast(1 AS bigint) AS now FROM documents WHERE doc_id % 9 = 0"
)

QUERIES["a5_dataset_digest"] = lambda spark, folder: rows_digest(Tables(spark, folder).read("labels").select("doc_id", "quality", "toxic"))
ORACLE["a5_dataset_digest"] = (
    "WITH h AS (SELECT sha256('{\"doc_id\":' || doc_id || ',\"quality\":' || quality || ',\"toxic\":' || toxic || '}') AS h FROM labels), "
    "n AS (SELECT count(*) AS c, sum(('0x' || substr(h, 1, 15))::ubigint::hugeint) AS a, sum(('0x' || substr(h, 16, 15))::ubigint::hugeint) AS b FROM h) "
    "SELECT c AS case_count, sha256(c || ':' || a::varchar || ':' || b::varchar) AS case_digest FROM n"
)

_HMAC_KEY = b"a fixed key for repeatable results"
QUERIES["h1_fingerprints"] = lambda spark, folder: P.accepted(PP._prepared(spark, folder)).select(
    "request_id", F.expr(R.fingerprint(_HMAC_KEY)).alias("fingerprint")
)
_JSON = (
    "'{\"engine\":\"heuristic\",\"fields\":{\"body\":\"' || replace(b.redacted, chr(10), '\\n') || "
    "'\",\"recipients\":\"[RECIPIENTS_REMOVED]\",\"sender\":\"[SENDER_REMOVED]\",\"subject\":\"' || s.redacted || "
    f"'\"}},\"policy_version\":\"{V.POLICY_VERSION}\",\"routing\":{{\"all_recipients_internal\":' || r.ai || "
    "',\"crosses_boundary\":' || r.cb || ',\"recipient_count\":' || r.n || '},\"use_case\":\"email\"}'"
)
_PAD = [bytes(x ^ k for x in _HMAC_KEY.ljust(64, b"\0")).hex() for k in (0x36, 0x5C)]
ORACLE["h1_fingerprints"] = (
    PP._FULL
    + ", dom AS (SELECT request_id, lower(split_part(sender, '@', -1)) AS sd, lower(split_part(unnest(rcpt), '@', -1)) AS d FROM verdict WHERE reject_reason IS NULL), "
    f"r AS (SELECT request_id, count(*) AS n, bool_or((d IN {O.INTERNAL}) <> (sd IN {O.INTERNAL}))::varchar AS cb, bool_and(d IN {O.INTERNAL})::varchar AS ai FROM dom GROUP BY request_id) "
    f"SELECT s.request_id, sha256(unhex('{_PAD[1]}') || unhex(sha256(unhex('{_PAD[0]}') || encode({_JSON})))) AS fingerprint "
    "FROM red s JOIN red b ON b.request_id = s.request_id AND s.ord = 2 AND b.ord = 3 JOIN r ON r.request_id = s.request_id"
).replace(") , dom AS", "), dom AS")


def h9_released_candidates(spark, folder):
    """Prepare, issue, two export attempts for each receipt, reconcile, release."""
    issued = R.issue(
        PP._prepared(spark, folder), _HMAC_KEY,
        token=F.concat(F.lit("t"), F.col("request_id").cast("string")), issued_at=F.timestamp_seconds("request_id"),
    )
    # of a candidate, what its fingerprint and its release need is stored
    kept = ["request_id", "use_case", "engine", "policy_version", "routing", "candidate_fields", "token", "issued_at", "fingerprint"]
    issued = written(issued.select(*kept), "issued")
    exports = issued.select(
        "token", "request_id", "issued_at", "fingerprint", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")
    ).select(
        F.expr("request_id * 3 + k").alias("event_id"),
        F.expr("timestampadd(SECOND, cast(request_id % 900 + (k - 1) * 5 AS int), issued_at)").alias("occurred_at"),
        F.lit("exported").alias("action"),
        "token",
        F.expr("CASE WHEN k = 1 AND request_id % 6 = 1 THEN 'another' ELSE fingerprint END").alias("fingerprint"),
        F.expr("k = 2 OR request_id % 7 <> 0").alias("confirmed"),
    )
    log = R.issue_events(issued, F.expr("request_id * 3")).unionByName(exports)
    released = R.export(issued, R.reconcile(log), _HMAC_KEY)
    return released.select(
        "request_id", F.expr("export_event % 3").cast("bigint").alias("attempt"), F.expr(P.reviewed_text()).alias("reviewed_text")
    )


QUERIES["h9_released_candidates"] = h9_released_candidates
ORACLE["h9_released_candidates"] = (
    f"SELECT * FROM (SELECT request_id, cast(CASE WHEN request_id % 900 < 600 AND request_id % 6 <> 1 AND request_id % 7 <> 0 THEN 1 "
    "WHEN request_id % 900 + 5 < 600 THEN 2 END AS bigint) AS attempt, reviewed_text "
    f"FROM ({PP.ORACLE['a9_reviewed_texts']})) WHERE attempt IS NOT NULL"
)


QUERIES["d13_candidate_bytes"] = lambda spark, folder: P.accepted(PP._prepared(spark, folder)).select(
    "request_id", F.expr(P.candidate_bytes("heuristic")).cast("bigint").alias("bytes")
)
_BODY_JSON = (
    "'{\"receipt\": \"' || repeat('x', 43) || '\", \"confirmed\": true, \"candidate\": {\"use_case\": \"email\", "
    f"\"policy_version\": \"{V.POLICY_VERSION}\", \"engine\": \"heuristic\", \"fields\": {{\"sender\": \"[SENDER_REMOVED]\", "
    "\"recipients\": \"[RECIPIENTS_REMOVED]\", \"subject\": \"' || s.redacted || '\", \"body\": \"' || "
    "replace(b.redacted, chr(10), '\\n') || '\"}, \"routing\": {\"recipient_count\": ' || r.n || ', \"crosses_example_boundary\": ' || "
    "r.cb || ', \"all_recipients_internal\": ' || r.ai || '}}}'"
)
ORACLE["d13_candidate_bytes"] = ORACLE["h1_fingerprints"].split("SELECT s.request_id, sha256(")[0] + (
    f"SELECT s.request_id, cast(length({_BODY_JSON}) AS bigint) AS bytes "
    "FROM red s JOIN red b ON b.request_id = s.request_id AND s.ord = 2 AND b.ord = 3 JOIN r ON r.request_id = s.request_id"
)
