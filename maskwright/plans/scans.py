"""Detection and redaction queries over every text of the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright import fixed_values as V
from maskwright.functions import spans as S
from maskwright.operators import detect as D
from maskwright.operators import sql_functions
from maskwright.operators.credentials import credential_spans
from maskwright.plans import oracle as O
from maskwright.sources.scratch import scratch_folder
from maskwright.sources.tables import Tables
from maskwright.sources.texts import read_texts

QUERIES = {}
ORACLE = {}


def _texts(spark, folder) -> DataFrame:
    return D.spread(Tables(spark, folder).texts())


def _rule_query(name: str):
    def query(spark, folder):
        found = S.hold(_texts(spark, folder), {"spans": D.rule_spans("text", name)})
        return D.explode_spans(found, ["text_id"]).select(
            "text_id", "label", F.col("start").cast("bigint").alias("start_at"),
            F.col("end").cast("bigint").alias("end_at"), "match_text",
        )

    return query


for _key, _rule in [
    ("b1_secret_spans", "secret"),
    ("b2_account_spans", "account"),
    ("b3_email_spans", "email"),
    ("b4_phone_spans", "phone"),
    ("b5_url_spans", "url"),
    ("b6_date_spans", "date"),
    ("b7_address_spans", "address"),
    ("b8_person_hint_spans", "person_hint"),
    ("b9_person_loose_spans", "person_loose"),
]:
    QUERIES[_key] = _rule_query(_rule)
    ORACLE[_key] = (
        O.with_(O.TEXTS, O.folded("folded", "texts", "text_id"), f"found AS ({O.rule('folded', 'text_id', _rule)})")
        + "SELECT text_id, label, s AS start_at, e AS end_at, substr(text, s + 1, e - s) AS match_text "
        "FROM found JOIN texts USING (text_id)"
    )


def b10_unmerged_counts(spark, folder):
    raw = _texts(spark, folder).select("kind", F.explode(F.expr(D.raw_spans("text"))).alias("s"))
    return raw.groupBy("kind", F.col("s.label").alias("label")).agg(
        F.count("*").alias("n"), F.expr("cast(sum(s.end - s.start) AS bigint)").alias("characters")
    )


QUERIES["b10_unmerged_counts"] = b10_unmerged_counts
ORACLE["b10_unmerged_counts"] = (
    O.with_(O.TEXTS, O.folded("folded", "texts", "text_id"), O.raw("found", "folded", "text_id"))
    + "SELECT kind, label, count(*) AS n, cast(sum(e - s) AS bigint) AS characters FROM found "
    "JOIN texts USING (text_id) GROUP BY kind, label"
)


def b11_detect_spans(spark, folder):
    found = D.explode_spans(D.detect(_texts(spark, folder)), ["text_id"])
    return found.select(
        "text_id", "label", F.col("start").cast("bigint").alias("start_at"),
        F.col("end").cast("bigint").alias("end_at"), "match_text", "placeholder",
    )


QUERIES["b11_detect_spans"] = b11_detect_spans
ORACLE["b11_detect_spans"] = (
    O.with_(O.DETECTED)
    + "SELECT text_id, label, s AS start_at, e AS end_at, substr(text, s + 1, e - s) AS match_text, "
    "'[' || upper(label) || ']' AS placeholder FROM spans JOIN texts USING (text_id)"
)


# Findings made elsewhere, some of them impossible, four to a document.
_FOREIGN = [
    ("private_person", "doc_id % 7 - 1", "doc_id % 7 + 4"),
    ("private_email", "doc_id % 5 + 3", "doc_id % 5 + 9"),
    ("secret", "doc_id % 11 + 8", "doc_id % 11 + 8 + doc_id % 3"),
    ("private_date", "12", "15"),
]
_FOREIGN_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS label, {a} AS s, {b} AS e, length(text) AS n FROM documents"
    for k, a, b in _FOREIGN
)


def _foreign(spark, folder) -> DataFrame:
    spans = ", ".join(S.span(f"cast({a} AS int)", f"cast({b} AS int)", f"'{k}'") for k, a, b in _FOREIGN)
    docs = Tables(spark, folder).read("documents").select("doc_id", "text")
    return D.spread(docs).withColumn("found", F.expr(f"array({spans})"))


def b12_invalid_texts(spark, folder):
    """Documents set aside because a foreign detector returned an impossible span."""
    return D.detect(_foreign(spark, folder), raw="found", strict=False).where("invalid").select("doc_id")


QUERIES["b12_invalid_texts"] = b12_invalid_texts
ORACLE["b12_invalid_texts"] = (
    f"WITH x AS ({_FOREIGN_SQL}) SELECT DISTINCT doc_id FROM x WHERE NOT (0 <= s AND s < e AND e <= n)"
)


def b13_merged_foreign(spark, folder):
    """Union ranges and the label of the strongest member, for foreign spans that overlap."""
    fine = D.detect(_foreign(spark, folder), raw="found", strict=False).where("NOT invalid")
    return D.explode_spans(fine, ["doc_id"], None).select(
        "doc_id", "label", F.col("start").cast("bigint").alias("start_at"), F.col("end").cast("bigint").alias("end_at")
    )


QUERIES["b13_merged_foreign"] = b13_merged_foreign
ORACLE["b13_merged_foreign"] = (
    O.with_(
        f"x AS ({_FOREIGN_SQL})",
        "fine AS (SELECT doc_id, label, s, e FROM x WHERE doc_id NOT IN "
        "(SELECT doc_id FROM x WHERE NOT (0 <= s AND s < e AND e <= n)))",
        O.merged("m", "fine", "doc_id"),
    )
    + "SELECT doc_id, label, s AS start_at, e AS end_at FROM m"
)


def b14_label_changes(spark, folder):
    """For merged spans of several matches: the label that won, against those that took part."""
    df = S.hold(_texts(spark, folder), {"found": D.raw_spans("text")})
    df = S.hold(df, {"spans": S.merge("found")})
    members = "filter(found, r -> r.start < s.end AND r.end > s.start)"
    return (
        df.select("found", F.explode("spans").alias("s"))
        .select(F.expr("s.label").alias("label"), F.expr(f"array_join(array_sort(({members}).label), '+')").alias("members"))
        .groupBy("label", "members")
        .agg(F.count("*").alias("n"))
    )


QUERIES["b14_label_changes"] = b14_label_changes
ORACLE["b14_label_changes"] = (
    O.with_(O.DETECTED)
    + "SELECT label, members, count(*) AS n FROM (SELECT m.text_id, m.s, m.label, "
    "string_agg(f.label, '+' ORDER BY f.label) AS members FROM spans m JOIN found f ON f.text_id = m.text_id "
    "AND f.s < m.e AND f.e > m.s GROUP BY m.text_id, m.s, m.label) GROUP BY label, members"
)


def b15_redacted_texts(spark, folder):
    return D.detect(_texts(spark, folder)).select("text_id", "redacted_text")


QUERIES["b15_redacted_texts"] = b15_redacted_texts
ORACLE["b15_redacted_texts"] = (
    O.with_(O.DETECTED, O.redacted("r", "texts", "spans", ["text_id"]))
    + "SELECT text_id, redacted AS redacted_text FROM r"
)


def b16_text_summary(spark, folder):
    counts = [f"coalesce(by_label['{k}'], 0L) AS {k}" for k in V.LABELS]
    return D.detect(_texts(spark, folder)).selectExpr("text_id", "span_count", *counts)


QUERIES["b16_text_summary"] = b16_text_summary
ORACLE["b16_text_summary"] = (
    O.with_(O.DETECTED)
    + "SELECT text_id, count(s) AS span_count, "
    + ", ".join(f"count(*) FILTER (WHERE label = '{k}') AS {k}" for k in V.LABELS)
    + " FROM texts LEFT JOIN spans USING (text_id) GROUP BY text_id"
)


def b17_minimized_result(spark, folder):
    """What may leave the scan: offsets, placeholders and the redacted copy, no source text."""
    shown = D.result(D.detect(_texts(spark, folder)), ["text_id"])
    rows = "transform(detected_spans, s -> concat_ws(':', s.label, s.start, s.end, s.placeholder))"
    return shown.select(
        "text_id", "schema_version", "offset_unit", "engine", "span_count",
        F.expr(f"array_join({rows}, '|')").alias("spans"),
        F.length("redacted_text").cast("bigint").alias("redacted_length"),
    )


QUERIES["b17_minimized_result"] = b17_minimized_result
ORACLE["b17_minimized_result"] = (
    O.with_(O.DETECTED)
    + f"SELECT text_id, {V.SCHEMA_VERSION} AS schema_version, '{V.OFFSET_UNIT}' AS offset_unit, "
    "'heuristic' AS engine, count(s) AS span_count, coalesce(string_agg(label || ':' || s || ':' || e || ':[' || "
    "upper(label) || ']', '|' ORDER BY s), '') AS spans, cast(length(any_value(text)) + coalesce(sum("
    "length(label) + 2 - (e - s)), 0) AS bigint) AS redacted_length FROM texts LEFT JOIN spans USING (text_id) GROUP BY text_id"
)


def label_totals_by_language(spark, folder):
    """Flagship: findings per language, source and label over all documents."""
    docs = Tables(spark, folder).read("documents").select("doc_id", "text", "lang", "source")
    found = D.spread(docs).select("lang", "source", F.explode(F.expr(S.bind("raw", D.raw_spans("text"), S.merge("raw")))).alias("s"))
    return found.groupBy("lang", "source", F.col("s.label").alias("label")).agg(
        F.count("*").alias("n"), F.expr("cast(sum(s.end - s.start) AS bigint)").alias("characters")
    )


QUERIES["label_totals_by_language"] = label_totals_by_language
ORACLE["label_totals_by_language"] = (
    O.with_(
        O.folded("folded", "documents", "doc_id"), O.raw("found", "folded", "doc_id"), O.merged("spans", "found", "doc_id")
    )
    + "SELECT lang, source, label, count(*) AS n, cast(sum(e - s) AS bigint) AS characters FROM spans "
    "JOIN documents USING (doc_id) GROUP BY lang, source, label"
)


def redaction_volume(spark, folder):
    """Documents, characters and masked characters per language and source."""
    docs = Tables(spark, folder).read("documents").select("doc_id", "text", "lang", "source")
    done = D.detect(D.spread(docs))
    return done.groupBy("lang", "source").agg(
        F.count("*").alias("documents"),
        F.sum(F.length("text").cast("bigint")).alias("characters"),
        F.sum(F.length("redacted_text").cast("bigint")).alias("redacted_characters"),
        F.sum("span_count").alias("spans"),
        F.expr("count_if(span_count > 0)").alias("sensitive"),
    )


QUERIES["redaction_volume"] = redaction_volume
ORACLE["redaction_volume"] = (
    O.with_(
        O.folded("folded", "documents", "doc_id"), O.raw("found", "folded", "doc_id"),
        O.merged("spans", "found", "doc_id"), O.redacted("r", "documents", "spans", ["doc_id"]),
        "c AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id)",
    )
    + "SELECT lang, source, count(*) AS documents, cast(sum(length(text)) AS bigint) AS characters, "
    "cast(sum(length(redacted)) AS bigint) AS redacted_characters, cast(coalesce(sum(n), 0) AS bigint) AS spans, "
    "count(n) AS sensitive FROM documents JOIN r USING (doc_id) LEFT JOIN c USING (doc_id) GROUP BY lang, source"
)


def _email_model():
    """A stand-in for a model: addresses found in Python, batch by batch."""
    import re

    import pandas as pd

    pattern = re.compile(next(p for name, _, p in V.RULES if name == "email"))

    def model(batches):
        for texts in batches:
            yield pd.Series([[("private_email", *m.span()) for m in pattern.finditer(t)] for t in texts])

    return model


def b18_model_adapter(spark, folder):
    """Documents scanned by a registered model, under the same checks, merge and redaction."""
    D.register_model("email_model", _email_model())
    docs = Tables(spark, folder).read("documents").select("doc_id", "text")
    return D.detect(D.spread(docs), engine="email_model").select("doc_id", "engine", "span_count", "redacted_text")


QUERIES["b18_model_adapter"] = b18_model_adapter
ORACLE["b18_model_adapter"] = (
    O.with_(
        O.folded("folded", "documents", "doc_id"), f"found AS ({O.rule('folded', 'doc_id', 'email')})",
        O.merged("spans", "found", "doc_id"), O.redacted("r", "documents", "spans", ["doc_id"]),
        "c AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id)",
    )
    + "SELECT doc_id, 'email_model' AS engine, coalesce(n, 0) AS span_count, redacted AS redacted_text FROM r LEFT JOIN c USING (doc_id)"
)


def b19_engine_choice(spark, folder):
    """All documents under each engine by name; every row says which one it was."""
    D.register_model("email_model", _email_model())
    docs = D.spread(Tables(spark, folder).read("documents").select("doc_id", "text"))
    both = [D.detect(docs, engine=name).select("doc_id", "engine", F.col("span_count").cast("bigint").alias("span_count")) for name in ("heuristic", "email_model")]
    return both[0].unionByName(both[1])


QUERIES["b19_engine_choice"] = b19_engine_choice
ORACLE["b19_engine_choice"] = (
    O.with_(
        O.folded("folded", "documents", "doc_id"), O.raw("found", "folded", "doc_id"), O.merged("spans", "found", "doc_id"),
        f"mail AS ({O.rule('folded', 'doc_id', 'email')})", O.merged("addresses", "mail", "doc_id"),
        "n AS (SELECT doc_id, 'heuristic' AS engine, count(*) AS n FROM spans GROUP BY doc_id UNION ALL "
        "SELECT doc_id, 'email_model', count(*) FROM addresses GROUP BY doc_id)",
    )
    + "SELECT d.doc_id, e.engine, coalesce(n.n, 0) AS span_count FROM documents d CROSS JOIN (VALUES ('heuristic'), ('email_model')) e(engine) "
    "LEFT JOIN n ON n.doc_id = d.doc_id AND n.engine = e.engine"
)


# Documents to a text file: a file is read whole by one task, so it must not grow with the table.
_FILE_DOCUMENTS = 256


def _text_files(docs: DataFrame, out: str) -> None:
    """A folder per language, in it plain text files of at most ``_FILE_DOCUMENTS`` documents; no shuffle."""
    docs.write.option("maxRecordsPerFile", _FILE_DOCUMENTS).partitionBy("lang").text(out)


def a8_scanned_files(spark, folder):
    """Documents as plain text files, a folder per language, scanned as files: characters and addresses of each."""
    out = scratch_folder(spark, "texts")
    docs = Tables(spark, folder).read("documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("value"))
    _text_files(docs, out)
    files = read_texts(spark, f"{out}/lang=*")
    rows = S.hold(files, {"found": D.rule_spans("text", "email")})
    return rows.groupBy(F.expr("regexp_extract(path, '/lang=([^/]*)/', 1)").alias("lang")).agg(
        F.sum(F.length("text")).alias("chars"), F.sum(F.size("found")).alias("addresses")
    )


QUERIES["a8_scanned_files"] = a8_scanned_files
ORACLE["a8_scanned_files"] = (
    O.with_(O.folded("folded", "documents", "doc_id"), f"found AS ({O.rule('folded', 'doc_id', 'email')})")
    + "SELECT coalesce(lang, 'none') AS lang, cast(sum(length(coalesce(text, '')) + 1) AS bigint) AS chars, "
    "cast(sum((SELECT count(*) FROM found f WHERE f.doc_id = d.doc_id)) AS bigint) AS addresses FROM documents d GROUP BY 1"
)


# The same scans by users who write SQL text only. The one-row generator `held` keeps Spark from copying the
# scan into every later use, as `spans.hold` does.
_SQL_FOUND = (
    "(SELECT text_id, kind, text, mw_find_spans(text) AS found FROM {texts}) "
    "LATERAL VIEW inline(array(struct(found))) held AS spans"
)


def _sql_query(text: str):
    def query(spark, folder):
        sql_functions.create(spark)
        return spark.sql(text, texts=_texts(spark, folder))

    return query


QUERIES["sql_detected_spans"] = _sql_query(
    "SELECT text_id, s.label AS label, cast(s.start AS bigint) AS start_at, cast(s.end AS bigint) AS end_at, "
    "mw_span_text(text, s.start, s.end) AS match_text, mw_span_placeholder(s.label) AS placeholder "
    f"FROM {_SQL_FOUND} LATERAL VIEW explode(spans) one AS s"
)
ORACLE["sql_detected_spans"] = ORACLE["b11_detect_spans"]

QUERIES["sql_redacted_texts"] = _sql_query(
    "SELECT text_id, kind, mw_redact_spans(text, spans) AS redacted, "
    "coalesce(mw_count_spans(spans)['private_email'], 0) AS emails, mw_valid_spans(text, spans) AS valid "
    f"FROM {_SQL_FOUND}"
)
ORACLE["sql_redacted_texts"] = (
    O.with_(
        O.DETECTED, O.redacted("r", "texts", "spans", ["text_id"]),
        "mail AS (SELECT text_id, count(*) AS n FROM spans WHERE label = 'private_email' GROUP BY text_id)",
    )
    + "SELECT text_id, kind, redacted, coalesce(n, 0) AS emails, true AS valid "
    "FROM texts JOIN r USING (text_id) LEFT JOIN mail USING (text_id)"
)


# Credential policy.
def c2_document_credentials(spark, folder):
    """Credential ranges of documents (assignments and credential-shaped values)."""
    docs = Tables(spark, folder).read("documents").select("doc_id", "text")
    found = S.hold(D.spread(docs), {"spans": credential_spans("text")})
    return D.explode_spans(found, ["doc_id"]).select(
        "doc_id", F.col("start").cast("bigint").alias("start_at"), F.col("end").cast("bigint").alias("end_at"), "match_text"
    )


QUERIES["c2_document_credentials"] = c2_document_credentials
ORACLE["c2_document_credentials"] = (
    O.with_(
        O.folded("folded", "documents", "doc_id"),
        f"found AS ({O.rule('folded', 'doc_id', 'secret')} UNION ALL {O.assignments('folded', 'doc_id')})",
        O.merged("spans", "found", "doc_id"),
    )
    + "SELECT doc_id, s AS start_at, e AS end_at, substr(text, s + 1, e - s) AS match_text "
    "FROM spans JOIN documents USING (doc_id)"
)


def _credentials_in(logs):
    """Credentials in pasted logs, with CRLF, CR and nested quotation."""

    def query(spark, folder):
        found = S.hold(D.spread(logs(Tables(spark, folder))), {"spans": credential_spans("text")})
        return D.explode_spans(found, ["event_id"]).select(
            "event_id", F.col("start").cast("bigint").alias("start_at"), F.col("end").cast("bigint").alias("end_at"), "match_text"
        )

    return query


# Headers, blocks and escaped quotes; then cookies, proxies, private keys, open and two-line quotes.
for _key, _logs, _cte in [("c_log_credentials", Tables.logs, O.LOGS), ("c_pasted_credentials", Tables.pasted, O.PASTED)]:
    QUERIES[_key] = _credentials_in(_logs)
    ORACLE[_key] = (
        f"WITH {_cte} SELECT event_id, lead_length AS start_at, lead_length + credential_length AS end_at, "
        "substr(text, lead_length + 1, credential_length) AS match_text FROM logs WHERE credential_length > 0"
    )
