import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from maskwright import fixed_values as V
from maskwright.functions import spans as S
from maskwright.operators import detect as D
from maskwright.operators import evaluate as E
from maskwright.sources import labelled as L

CASE = f"case_id string, text string, gold {S.SPANS}, groups array<string>, own {S.SPANS}"


def score(spark, rows):
    df = spark.createDataFrame(rows, CASE)
    return E.score(D.detect(df, raw="own"))


def test_exact_and_character_counts(spark):
    rows = [
        ("partial", "abc def", [(0, 3, "secret"), (4, 7, "private_person")], ["a"], [(0, 2, "secret"), (4, 7, "private_email")]),
        ("over", "a b", [], ["a", "b"], [(0, 3, "private_person")]),
        ("empty", "", [], [], []),
        ("twice", "xx yy", [(0, 2, "secret"), (0, 2, "secret"), (1, 5, "private_url")], ["b"], [(0, 2, "secret")]),
    ]
    got = {r.case_id: r for r in score(spark, rows).collect()}
    names = ["true_positives", "false_positives", "false_negatives", "sensitive_characters", "unredacted_sensitive_characters", "extra_redacted_characters", "precision", "recall"]
    assert {k: tuple(r[n] for n in names) for k, r in got.items()} == {
        "partial": (0, 2, 2, 6, 1, 0, 0.0, 0.0),
        "over": (0, 1, 0, 0, 0, 3, 0.0, None),
        "empty": (0, 0, 0, 0, 0, 0, None, None),
        "twice": (1, 0, 1, 5, 3, 0, 1.0, 0.5),
    }
    total = E.totals(score(spark, rows)).first()
    assert (total.case_count, total.true_positives, total.precision, total.sensitive_character_coverage) == (4, 1, 0.25, 0.636364)
    labels = {r.label: r for r in E.by_label(score(spark, rows)).collect()}
    assert len(labels) == 8 and labels["private_date"].precision is None
    assert (labels["secret"].true_positives, labels["secret"].false_positives, labels["secret"].false_negatives) == (1, 1, 1)
    groups = {r.group: r.case_count for r in E.by_group(score(spark, rows)).collect()}
    assert groups == {"a": 2, "b": 2}
    assert not {"text", "redacted_text"} & set(E.case_rows(score(spark, rows)).columns)
    assert E.totals(score(spark, rows[2:3])).first().sensitive_character_coverage is None


def test_character_counts_match_position_sets(spark):
    rng = random.Random(2)

    def some():
        return [(a, a + rng.randint(1, 8), rng.choice(V.LABELS)) for a in (rng.randrange(50) for _ in range(rng.randint(0, 6)))]

    rows = [(str(i), "z" * 60, some(), [], some()) for i in range(40)]
    got = {r.case_id: r for r in score(spark, rows).collect()}
    for key, _, gold, _, own in rows:
        g = {c for a, b, _ in gold for c in range(a, b)}
        p = {c for a, b, _ in own for c in range(a, b)}
        r = got[key]
        assert (r.sensitive_characters, r.unredacted_sensitive_characters, r.extra_redacted_characters) == (len(g), len(g - p), len(p - g))


def test_inconsistent_results_are_refused(spark):
    df = spark.createDataFrame([("leak", "carla@mail.example", [(0, 18, "private_email")], [], [(0, 18, "private_email")])], CASE)
    leak = D.detect(df, raw="own").withColumn("redacted_text", F.col("text"))
    with pytest.raises(Exception, match="does not match"):
        E.score(leak).collect()
    assert E.integrity_errors(leak).first().error == "redaction_mismatch"
    assert E.score(leak, strict=False).count() == 1
    overlap = D.detect(df, raw="own").withColumn("spans", F.expr("concat(spans, spans)"))
    assert E.integrity_errors(overlap).first().error == "invalid_span"


def test_engines_must_not_mix(spark):
    scored = score(spark, [("a", "x", [], [], []), ("b", "y", [], [], [])])
    assert E.mixed_engines(scored).count() == 0
    assert E.mixed_engines(scored.withColumn("engine", F.col("case_id"))).count() == 2


def dataset(tmp_path, cases, version=1):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps({"schema_version": version, "description": "d", "cases": cases}, ensure_ascii=False))
    return str(path)


def test_labelled_file_to_report_and_gate(spark, tmp_path):
    cases = [
        {"id": "one", "groups": ["mail", "emoji"], "segments": ["😀 to ", {"label": "private_email", "text": "carla@mail.example"}, " and ", {"label": "private_email", "text": "carla@mail.example"}]},
        {"id": "json-like", "segments": ['{"label": "secret", "text": "not an annotation"}', {"label": "secret", "text": '"token"'}]},
        {"id": "none", "segments": [""]},
    ]
    path = dataset(tmp_path, cases)
    loaded = E.assemble(L.read_cases(spark, path))
    rows = {r.case_id: r for r in loaded.collect()}
    assert rows["one"].text == "😀 to carla@mail.example and carla@mail.example"
    assert [(s.start, s.end, s.label) for s in rows["one"].gold] == [(5, 23, "private_email"), (28, 46, "private_email")]
    assert rows["json-like"].text == '{"label": "secret", "text": "not an annotation"}"token"'
    assert [(s.start, s.end) for s in rows["json-like"].gold] == [(48, 55)] and rows["none"].text == ""
    assert E.dataset_errors(L.read_cases(spark, path)).count() == 0
    digest = L.fingerprint(spark, path).first().dataset_sha256
    assert digest == hashlib.sha256(open(path, "rb").read()).hexdigest()

    scored = E.score(D.detect(loaded))
    report = L.stamp(E.case_rows(scored), "heuristic", digest)
    assert E.totals(scored).first().true_positives == 2
    old = {
        "schema_version": 1, "engine": "heuristic", "dataset_sha256": digest,
        "cases": [{"id": r.case_id, "true_positives": r.true_positives, **{c: r[c] for c in V.ERROR_COUNTS}} for r in report.collect()],
    }

    def gate(change):
        edited = json.loads(json.dumps(old))
        change(edited)
        target = tmp_path / "baseline.json"
        target.write_text(json.dumps(edited))
        return [tuple(r) for r in E.regressions(report, L.read_baseline(spark, str(target))).collect()]

    assert gate(lambda b: None) == []
    assert gate(lambda b: b["cases"][1].update(false_negatives=9)) == []
    assert gate(lambda b: b["cases"][0].update(extra_redacted_characters=-1)) == [(old["cases"][0]["id"], "extra_redacted_characters", -1, 0)]
    assert [r[1] for r in gate(lambda b: b.update(dataset_sha256="other"))] == ["dataset_sha256"]
    assert [r[1] for r in gate(lambda b: b["cases"].pop())] == ["case_ids"]

    out = tmp_path / "report"
    L.write_report(report, str(out))
    assert spark.read.json(str(out)).count() == 3
    with pytest.raises(ValueError, match="source text"):
        L.write_report(loaded, str(tmp_path / "bad"))


@pytest.mark.parametrize(
    "case,error",
    [
        ([{"id": "a", "segments": []}, {"id": "a", "segments": []}], "duplicate_id"),
        ([{"id": "", "segments": []}], "missing_id"),
        ([{"id": "a", "segments": [{"label": "invented", "text": "v"}]}], "unknown_label"),
        ([{"id": "a", "segments": [{"text": "v"}]}], "unknown_label"),
        ([{"id": "a", "segments": [{"label": "secret", "text": ""}]}], "empty_annotation"),
        ([{"id": "a", "groups": ["x", "x"], "segments": []}], "invalid_groups"),
        ([{"id": "a", "groups": ["Raw@x"], "segments": []}], "invalid_groups"),
        ([{"id": "a", "groups": ["x" * 33], "segments": []}], "invalid_groups"),
    ],
)
def test_dataset_rules(spark, tmp_path, case, error):
    assert [r.error for r in E.dataset_errors(L.read_cases(spark, dataset(tmp_path, case))).collect()] == [error]


@pytest.mark.parametrize("cases,version", [([], 1), ([{"id": "a", "segments": []}], 2)])
def test_unusable_files_stop(spark, tmp_path, cases, version):
    with pytest.raises(Exception, match="schema version 1"):
        L.read_cases(spark, dataset(tmp_path, cases, version)).collect()


@pytest.mark.parametrize(
    "spans",
    [
        [(0, 3, "secret"), (2, 5, "secret")],
        [(3, 5, "secret"), (0, 2, "secret")],
        [(0, 3, "invented")],
        [(0, 3, None)],
        [(4, 9, "secret")],
        [(None, 2, "secret")],
    ],
)
def test_unsound_spans_are_refused(spark, spans):
    row = [("c", "abcdef", ["g"], "heuristic", [], spans, "abcdef")]
    span = "array<struct<start:int,end:int,label:string>>"
    df = spark.createDataFrame(row, f"case_id string, text string, groups array<string>, engine string, gold {span}, spans {span}, redacted_text string")
    assert [r.error for r in E.integrity_errors(df).collect()] == ["invalid_span"]
    with pytest.raises(Exception, match="invalid detector span"):
        E.score(df).collect()


def test_gate_ends_at_the_first_difference(spark):
    counts = ", ".join(f"{c} bigint" for c in V.ERROR_COUNTS)
    schema = f"schema_version int, engine string, dataset_sha256 string, case_id string, {counts}"

    def side(digest, cases):
        return spark.createDataFrame([(1, "e", digest, c, n, n, n, n) for c, n in cases], schema)

    def checks(new, old):
        return sorted({(r.case_id, r.check) for r in E.regressions(new, old).collect()}, key=str)

    assert checks(side("d", [("a", 2)]), side("d", [("a", 2)])) == []
    assert {c for _, c in checks(side("d", [("a", 2)]), side("d", [("a", 1)]))} == set(V.ERROR_COUNTS)
    assert checks(side("d", [("a", 2), ("b", 0)]), side("d", [("a", 1)])) == [("b", "case_ids")]
    assert checks(side("d", [("a", 2), ("b", 0)]), side(None, [("a", 1)])) == [(None, "dataset_sha256")]
    assert checks(side(None, [("a", 1)]), side(None, [("a", 1)])) == [(None, "dataset_sha256")]
    # a side without cases, or with a case twice or without an id, is no report
    assert checks(side("d", []), side("d", [])) == checks(side("d", [("a", 1)]), side("d", [])) == [(None, "no_cases")]
    assert checks(side("d", [("a", 1), ("a", 1)]), side("d", [("a", 1), ("a", 1)])) == [("a", "repeated_ids")]
    assert checks(side("d", [("a", 1), ("b", 9)]), side("d", [("a", 1), ("a", 2), ("b", 1)])) == [("a", "repeated_ids")]
    assert checks(side("d", [(None, 1)]), side("d", [(None, 1)])) == [(None, "repeated_ids")]


def test_report_folders(spark, tmp_path):
    text = "mail carla@mail.example now"
    gold = [(5, 23, "private_email")]
    span = "array<struct<start:int,end:int,label:string>>"
    cases = spark.createDataFrame([(f"c{k}", text, ["g"] if k else ["g", "h"], gold if k else []) for k in range(4)], f"case_id string, text string, groups array<string>, gold {span}")
    scored = E.score(D.detect(cases)).cache()
    a, b, c = (str(tmp_path / n) for n in "abc")
    L.write_report_folder(scored, a, engine="heuristic", digest="d")
    L.write_report_folder(scored.withColumn("false_positives", F.lit(0).cast("bigint")), b, engine="heuristic", digest="d")
    parts = L.read_report_folder(spark, a)
    assert parts["totals"].first().case_count == 4 and {r.group: r.case_count for r in parts["groups"].collect()} == {"g": 4, "h": 1}
    assert parts["labels"].count() == len(V.LABELS) and all("text" not in p.columns for p in parts.values())
    assert L.gate(spark, a, a).count() == 0
    assert [tuple(r) for r in L.gate(spark, a, b).collect()] == [("c0", "false_positives", 0, 1)]
    # half-written, changed behind its manifest, of another version
    L.write_report(E.case_rows(scored), f"{c}/cases", "parquet")
    with pytest.raises(Exception, match="manifest|PATH_NOT_FOUND"):
        L.read_report_folder(spark, c)
    spark.read.parquet(f"{a}/cases").limit(1).write.mode("append").parquet(f"{b}/cases")
    with pytest.raises(ValueError, match="not those of its manifest"):
        L.gate(spark, a, b)
    manifest = spark.read.parquet(f"{a}/manifest")
    spark.createDataFrame(manifest.withColumn("schema_version", F.lit(9)).collect(), manifest.schema).write.mode("overwrite").parquet(f"{c}/manifest")
    with pytest.raises(ValueError, match="schema version"):
        L.read_report_folder(spark, c)
    rows = spark.range(50).selectExpr("id", "id % 3 AS x")
    digest = L.rows_digest(rows).first()
    assert digest == L.rows_digest(rows.repartition(7)).first() and digest != L.rows_digest(rows.where("id > 0")).first() != L.rows_digest(rows.unionAll(rows)).first()
