"""The scan as SQL functions: same results as the operators, nulls, one computation per row."""

from pyspark.sql import functions as F

from maskwright.operators import detect as D
from maskwright.operators import sql_functions as Q

TEXTS = [
    (1, "mail anna@corp.example or call 555-010-7788, password=hunter2hunter2"),
    (2, ""),
    (3, None),
    (4, "on 2024-03-05 see https://host.example/a; 😀 carl@x.example"),
    (4, "on 2024-03-05 see https://host.example/a; 😀 carl@x.example"),
    (5, "no finding at all"),
]


def rows(spark):
    return spark.createDataFrame(TEXTS, "id int, text string")


def test_same_as_operators(spark):
    names = Q.create(spark)
    assert "mw_find_spans" in names and "mw_find_email" in names
    got = spark.sql(
        "SELECT id, text, spans, mw_redact_spans(text, spans) AS redacted, mw_count_spans(spans) AS by_label, "
        "mw_valid_spans(text, spans) AS valid FROM (SELECT *, mw_find_spans(text) AS spans FROM {rows})",
        rows=rows(spark),
    ).collect()
    want = D.detect(rows(spark).where("text IS NOT NULL")).collect()
    key = lambda r: (r.id, r.text)
    seen = sorted((r for r in got if r.text is not None), key=key)
    assert [(r.spans, r.redacted, r.by_label) for r in seen] == [
        (r.spans, r.redacted_text, r.by_label) for r in sorted(want, key=key)
    ]
    assert all(r.valid for r in seen) and any(len(r.spans) > 1 for r in seen)
    (null,) = [r for r in got if r.text is None]
    assert null.spans is None and null.redacted is None and null.by_label is None and null.valid is None


def test_merge_credentials_and_bad_spans(spark):
    Q.create(spark, "own_")
    row = spark.sql(
        "SELECT own_merge_spans(array(named_struct('start', 0, 'end', 4, 'label', 'private_date'), "
        "named_struct('start', 2, 'end', 5, 'label', 'secret'))) AS merged, "
        "own_find_credentials('x token=abcdefgh1234 y') AS found, "
        "own_valid_spans('abc', array(named_struct('start', 1, 'end', 9, 'label', 'secret'))) AS outside, "
        "own_valid_spans('abc', array(named_struct('start', 0, 'end', 1, 'label', 'nothing'))) AS unknown, "
        "own_span_text('a😀bc', 1, 3) AS part, own_span_placeholder('secret') AS mark"
    ).first()
    assert [tuple(s) for s in row.merged] == [(0, 5, "secret")]
    assert [(s.start, s.end) for s in row.found] and not row.outside and not row.unknown
    assert (row.part, row.mark) == ("😀b", "[SECRET]")


def test_one_computation(spark):
    """Held by a one-row generator, the scan stands in the plan once, whatever is built on it."""
    Q.create(spark)
    df = spark.sql(
        "SELECT id, s.start, mw_redact_spans(text, spans) AS r FROM (SELECT *, mw_find_spans(text) AS found FROM {rows}) "
        "LATERAL VIEW inline(array(struct(found))) held AS spans LATERAL VIEW explode(spans) one AS s",
        rows=rows(spark),
    )
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == len(D.JAVA_RULES) and "Python" not in plan
    once = rows(spark).select(F.expr(D.raw_spans("text")).alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") <= once.count("regexp_extract_all(") + 1
