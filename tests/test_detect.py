import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.operators import detect as D


def redacted(spark, *texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = {r.id: r for r in D.detect(df, **options).collect()}
    return [rows[i] for i in range(len(texts))]


def test_documented_examples(spark):
    rows = redacted(
        spark,
        "😀 carla@mail.example 👩🏽‍💻",
        "Regards,\nGreta Holm\nTomorrow",
        "Regards,\nGreta Holm\nPassword=sample-value",
        "Regards, Greta Holm Password=sample-value",
        "",
    )
    assert rows[0].redacted_text == "😀 [PRIVATE_EMAIL] 👩🏽‍💻"
    assert [(s.start, s.end) for s in rows[0].spans] == [(2, 20)]
    assert rows[1].redacted_text == "Regards,\n[PRIVATE_PERSON]\nTomorrow"
    assert all("sample-value" not in r.redacted_text and "secret" in r.by_label for r in rows[2:4])
    assert rows[4].redacted_text == "" and rows[4].span_count == 0 and rows[4].by_label == {}
    assert {r.engine for r in rows} == {"heuristic"}


def shouting():
    """A stand-in for a model; defined in a function so that it travels to the workers by value."""

    def model(batches):
        for texts in batches:
            yield pd.Series([[("secret", 0, len(t)), ("private_person", 0, 3)] if t.isupper() else [] for t in texts])

    return model


def test_a_model_gets_the_same_merge_and_redaction(spark):
    D.register_model("shouting", shouting())
    loud, quiet = redacted(spark, "ABCDEF", "abcdef", engine="shouting")
    assert loud.redacted_text == "[SECRET]" and loud.by_label == {"secret": 1} and loud.engine == "shouting"
    assert quiet.redacted_text == "abcdef"


def test_engines_are_never_swapped_silently(spark):
    with pytest.raises(ValueError, match="unknown detection engine"):
        redacted(spark, "x", engine="absent")
    with pytest.raises(ValueError):
        D.register_model("heuristic", shouting())


@pytest.mark.parametrize("start,end,label", [(-1, 2, "secret"), (2, 2, "secret"), (0, 4, "secret"), (0, 1, "invented")])
def test_impossible_spans_stop_the_job_or_set_the_row_aside(spark, start, end, label):
    df = spark.createDataFrame([("abc", [(start, end, label)]), ("abc", [(0, 1, "secret")])], f"text string, own {S.SPANS}")
    with pytest.raises(Exception, match="invalid span"):
        D.detect(df, raw="own").collect()
    bad, good = D.detect(df, raw="own", strict=False).orderBy(F.desc("invalid")).collect()
    assert bad.invalid and bad.spans is None and bad.redacted_text is None
    assert good.redacted_text == "[SECRET]bc"


def test_result_holds_no_source_unless_asked(spark):
    df = spark.createDataFrame([(1, "to carla@mail.example")], "id int, text string")
    done = D.detect(df)
    plain = D.result(done, ["id"])
    assert "text" not in plain.columns
    assert "carla" not in str(plain.collect())
    full = D.result(done, ["id"], include_source=True).first()
    assert full.text == "to carla@mail.example" and full.detected_spans[0].text == "carla@mail.example"


def test_small_inputs_are_spread_and_large_ones_are_left_alone(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("text")).coalesce(1)
    assert D.spread(df).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    big = spark.range(0, 10**12, 1, 3)
    assert D.spread(big).rdd.getNumPartitions() == 3
