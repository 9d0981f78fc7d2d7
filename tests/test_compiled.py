"""Scans stay in generated code, and the short ways of span expressions give what the long ones give."""

import random
import re

import pytest

from maskwright.functions import spans as S
from maskwright.operators import detect, mail, prepare


def _generators(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.split("\n") if re.search(r"\bGenerate ", line)]


@pytest.mark.parametrize("kind", ["detect", "mail", "prepare"])
def test_no_pattern_is_searched_inside_a_generator(spark, kind):
    """Spark interprets generators, so what they hand on must have been computed below them."""
    spark.conf.set("spark.sql.maxPlanStringLength", "100000000")
    if kind == "detect":
        df = detect.detect(spark.createDataFrame([("a@b.co",)], "text string"))
    elif kind == "mail":
        rows = spark.createDataFrame([("outbound", "a@b.co", ["c@d.ef"], "s", "b")], "direction string, sender string, recipients array<string>, subject string, body string")
        df = mail.scan_all(rows, ["b.co"])
    else:
        rows = spark.createDataFrame([("1", "ai_prompt", {"text": "T"}, None)], f"request_id string, use_case string, fields map<string,string>, manual_masks {prepare.MASKS}")
        df = prepare.prepare(rows)
    found = _generators(df)
    assert found and not any("regexp" in g or "RLIKE" in g or "rlike" in g for g in found)


def test_few_spans_merge_and_redact_as_many(spark, monkeypatch):
    rng = random.Random(4)
    labels = ["secret", "private_email", "private_person"]
    rows = [([(a, a + rng.randrange(1, 7), rng.choice(labels)) for a in (rng.randrange(40) for _ in range(rng.randrange(19)))],) for _ in range(300)]
    df = spark.createDataFrame(rows, f"spans {S.SPANS}").withColumn("text", S.F.lit("0123456789" * 5))
    got = df.selectExpr("spans", "text", f"{S.merge('spans')} AS m")
    monkeypatch.setattr(S, "FEW", 0)
    want = df.selectExpr(f"transform({S.merge('spans')}, x -> x) AS m").collect()
    done = got.selectExpr("m", f"{S.redact('text', 'm', lambda s: S.placeholder(f'{s}.label'))} AS redacted").collect()
    for row, other, (spans,) in zip(done, want, rows, strict=True):
        if len(spans) > 1:
            assert row.m == other.m
        text = "0123456789" * 5
        for s in reversed(row.m):
            text = text[: s.start] + f"[{s.label.upper()}]" + text[s.end :]
        assert row.redacted == text


@pytest.mark.parametrize("mark", ["", S.MARK])
def test_any_number_of_matches_has_its_places(spark, mark):
    texts = [mark + "é" * (k % 3) + "ab 😀".join(["12"] * k) + "x" for k in (0, 1, 2, 3, 15, 16, 17, 18, 40, 130, 300)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    got = [[(s.start, s.end) for s in r.f] for r in df.selectExpr(f"{S.find_all('text', '[0-9]+', 'secret')} AS f").collect()]
    assert got == [[m.span() for m in re.finditer("[0-9]+", t)] for t in texts] + [[]]


def test_sorted_spans_merge_as_any_others(spark):
    rng = random.Random(9)
    labels = ["secret", "private_email", "private_person"]
    rows = [(sorted((a, a + rng.randrange(1, 7), rng.choice(labels)) for a in (rng.randrange(25) for _ in range(rng.randrange(11)))),) for _ in range(400)]
    df = spark.createDataFrame(rows, f"spans {S.SPANS}")
    assert df.selectExpr(f"{S.merge_sorted('spans')} AS a", f"{S.merge('spans')} AS b").where("NOT a <=> b").count() == 0


def test_findings_are_not_stored_with_candidates(spark, monkeypatch):
    from maskwright.plans import evals

    stored = []
    monkeypatch.setattr(evals, "written", lambda df, name: stored.append(df.columns) or df)
    evals.h9_released_candidates(spark, "/root/testdata/sf0.001")
    assert stored and not {"findings", "by_label", "span_count"} & set(stored[0])
