"""Score detected spans against labelled ones, per case, label and slice, and gate regressions.

A scored case is one row: ``case_id``, ``text``, ``gold`` and ``spans`` (arrays of spans), ``groups``,
``engine`` and ``redacted_text``. Character counts come from lengths of merged ranges,
|gold ∩ found| = |gold| + |found| − |gold ∪ found|, so no row is made per character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskwright import fixed_values as V
from maskwright.functions import spans as S
from maskwright.operators.dashboard import label_list

_COUNTS = ["true_positives", "false_positives", "false_negatives"]
_CHARS = [
    "sensitive_characters",
    "unredacted_sensitive_characters",
    "extra_redacted_characters",
]


def ratio(part: Column, whole: Column) -> Column:
    """Rounded to six digits; null when undefined."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 6)


def with_ratios(df: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in _COUNTS)
    return df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})


def _sound(spans: str, text: str) -> str:
    """Every span lies in the text and has a known label; spans are in order and do not overlap."""
    labels = ", ".join(repr(k) for k in V.LABELS)
    return (
        f"(coalesce({S.is_valid(spans, text)}, false) AND forall({spans}, k -> coalesce(k.label, '') IN ({labels})) AND "
        f"NOT exists(transform({spans}, (k, i) -> i > 0 AND k.start < get({spans}, i - 1).end), x -> x))"
    )


def integrity_errors(df: DataFrame) -> DataFrame:
    """Cases whose spans or redacted text are not consistent with their text."""
    rebuilt = S.redact("text", "spans", lambda s: S.placeholder(f"{s}.label"))
    return df.select(
        "case_id",
        F.expr(
            f"CASE WHEN NOT {_sound('spans', 'text')} THEN 'invalid_span' "
            f"WHEN NOT redacted_text <=> {rebuilt} THEN 'redaction_mismatch' END"
        ).alias("error"),
    ).where("error IS NOT NULL")


def _keys(spans: str) -> str:
    return f"array_distinct(transform({spans}, k -> concat_ws(':', k.label, k.start, k.end)))"


def score(df: DataFrame, *, strict: bool = True) -> DataFrame:
    """Exact-span and character counts of every case. Holds no text.

    With ``strict`` an inconsistent case stops the job; otherwise it is scored as it stands and can
    be listed with :func:`integrity_errors`.
    """
    found = "spans"
    if strict:
        rebuilt = S.redact("text", "spans", lambda s: S.placeholder(f"{s}.label"))
        found = (
            f"CASE WHEN NOT {_sound('spans', 'text')} THEN raise_error('invalid detector span') "
            f"WHEN NOT redacted_text <=> {rebuilt} THEN raise_error('redacted text does not match spans') "
            "ELSE spans END"
        )
    df = S.hold(df.select("case_id", "engine", "groups", "gold", "spans", "text", "redacted_text"), {"spans": found})
    df = S.hold(
        df,
        {
            "_g": _keys("gold"),
            "_p": _keys("spans"),
            "_gold": S.covered(S.merge("gold")),
            "_pred": S.covered(S.merge("spans")),
            "_both": S.bind("both", "concat(gold, spans)", S.covered(S.merge("both"))),
        },
    )
    return with_ratios(
        df.select(
            "case_id",
            "engine",
            "groups",
            "gold",
            "spans",
            F.expr("cast(size(array_intersect(_g, _p)) AS bigint)").alias("true_positives"),
            F.expr("cast(size(array_except(_p, _g)) AS bigint)").alias("false_positives"),
            F.expr("cast(size(array_except(_g, _p)) AS bigint)").alias("false_negatives"),
            F.col("_gold").alias("sensitive_characters"),
            F.expr("_both - _pred").alias("unredacted_sensitive_characters"),
            F.expr("_both - _gold").alias("extra_redacted_characters"),
        )
    )


def case_rows(scored: DataFrame) -> DataFrame:
    """The report row of each case, without spans or text."""
    return scored.select("case_id", *_COUNTS, "precision", "recall", *_CHARS)


def _sums() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*_COUNTS, *_CHARS]]


def totals(scored: DataFrame) -> DataFrame:
    sensitive = F.col("sensitive_characters")
    return with_ratios(scored.agg(F.count("*").alias("case_count"), *_sums())).withColumn(
        "sensitive_character_coverage",
        ratio(sensitive - F.col("unredacted_sensitive_characters"), sensitive),
    )


def by_label(scored: DataFrame) -> DataFrame:
    """Exact-span counts of every label, including labels that never occur."""
    parts = ("array_intersect(g, p)", "array_except(p, g)", "array_except(g, p)")
    rows = ", ".join(
        f"transform({keys}, k -> struct(split_part(k, ':', 1) AS label, {i} AS kind))"
        for i, keys in enumerate(parts)
    )
    counted = (
        scored.select(F.expr(_keys("gold")).alias("g"), F.expr(_keys("spans")).alias("p"))
        .select(F.explode(F.expr(f"concat({rows})")).alias("k"))
        .groupBy(F.col("k.label").alias("label"))
        .agg(*[F.expr(f"count_if(k.kind = {i})").alias(c) for i, c in enumerate(_COUNTS)])
    )
    full = label_list(scored.sparkSession).join(counted, "label", "left")
    return with_ratios(
        full.select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS])
    )


def by_group(scored: DataFrame) -> DataFrame:
    """Counts per slice. A case counts in each of its groups, so slices must not be added up."""
    rows = scored.select(F.explode("groups").alias("group"), *_COUNTS, *_CHARS)
    return with_ratios(rows.groupBy("group").agg(F.count("*").alias("case_count"), *_sums()))


def mixed_engines(scored: DataFrame) -> DataFrame:
    """Empty when one report holds one engine; else the engines it mixes."""
    return (
        scored.groupBy("engine")
        .agg(F.count("*").alias("cases"))
        .withColumn("engines", F.count("*").over(W.partitionBy(F.lit(0))))  # a row per engine
        .where("engines > 1")
        .drop("engines")
    )


def regressions(report: DataFrame, baseline: DataFrame) -> DataFrame:
    """Error counts that rose, or what makes the two sides incomparable. No rows means pass.

    Both sides hold ``schema_version``, ``engine``, ``dataset_sha256``, ``case_id`` and the four
    error counts. The first of these findings ends the comparison: a side has no cases, or one of the first
    three columns differs, is mixed or is null (one row); a side repeats a case or has one without an id (a row
    each, with how often it stands); cases stand on one side only (a row each); counts rose.
    Both sides are read more than once, so hand over stored tables.
    """
    head = ["schema_version", "engine", "dataset_sha256"]
    differs = ", ".join(f"CASE WHEN min({c}) <> max({c}) OR count({c}) < count(*) THEN '{c}' END" for c in head)
    sides = report.select(F.lit(1).alias("new"), *head, "case_id").unionByName(baseline.select(F.lit(0).alias("new"), *head, "case_id"))
    empty = "CASE WHEN count_if(new = 1) = 0 OR count_if(new = 0) = 0 THEN 'no_cases' END"
    mismatch = sides.agg(F.expr(f"get(array_compact(array({empty}, {differs})), 0)").alias("mismatch"))
    times = sides.groupBy("case_id").agg(F.expr("count_if(new = 0)").alias("was"), F.expr("count_if(new = 1)").alias("now"))
    repeated = times.where("was > 1 OR now > 1 OR case_id IS NULL").select("case_id", F.lit("repeated_ids").alias("check"), "was", "now")
    # one row a case, so that a repeated one does not multiply the join
    sums = [F.max(c).alias(c) for c in V.ERROR_COUNTS]
    new, old = (side.groupBy("case_id").agg(*sums) for side in (report, baseline))
    new = new.select("case_id", *[F.col(c).alias(f"new_{c}") for c in V.ERROR_COUNTS], F.lit(1).alias("in_new"))
    old = old.select("case_id", *[F.col(c).alias(f"old_{c}") for c in V.ERROR_COUNTS], F.lit(1).alias("in_old"))
    pairs = ", ".join(f"struct('{c}' AS check, old_{c} AS was, new_{c} AS now)" for c in V.ERROR_COUNTS)
    found = new.join(old, "case_id", "full").select(
        "case_id",
        F.inline(
            F.expr(
                "CASE WHEN in_new IS NULL OR in_old IS NULL THEN "
                "array(struct('case_ids' AS check, cast(in_old AS bigint) AS was, "
                "cast(in_new AS bigint) AS now)) "
                f"ELSE filter(array({pairs}), c -> c.now > c.was) END"
            )
        ),
    )
    one_sided = found.agg(F.expr("coalesce(bool_or(check = 'case_ids'), false)").alias("one_sided"))
    failed = mismatch.where("mismatch IS NOT NULL").select(
        F.lit(None).cast(dict(report.dtypes)["case_id"]).alias("case_id"),
        F.col("mismatch").alias("check"),
        F.lit(None).cast("bigint").alias("was"),
        F.lit(None).cast("bigint").alias("now"),
    )
    none_repeated = repeated.agg(F.expr("count(*) = 0").alias("none"))
    wrong_ids = repeated.where(mismatch.scalar().isNull())
    rose = found.where(mismatch.scalar().isNull() & none_repeated.scalar() & ((F.col("check") == "case_ids") == one_sided.scalar()))
    return failed.unionByName(wrong_ids).unionByName(rose)


def compare_engines(scored: DataFrame) -> DataFrame:
    """Totals of several engines over one dataset, side by side."""
    per = scored.groupBy("engine").agg(F.count("*").alias("case_count"), *_sums())
    return with_ratios(per)


def assemble(cases: DataFrame) -> DataFrame:
    """Build texts and gold spans from ``segments``: array<struct<label, text>>, null label = plain.

    Offsets follow from the running length, inside the row.
    """
    gold = S.fold(
        "segments",
        "0",
        S.SPANS,
        lambda s, x: f"{s} + length({x}.text)",
        lambda s, x: f"CASE WHEN {x}.label IS NOT NULL THEN "
        f"array({S.span(s, f'{s} + length({x}.text)', f'{x}.label')}) ELSE {S.NO_SPANS} END",
    )
    return cases.withColumns(
        {"text": F.expr("concat_ws('', segments.text)"), "gold": F.expr(gold)}
    ).drop("segments")


def dataset_errors(cases: DataFrame) -> DataFrame:
    """Labelled cases that break the rules of a dataset: (case_id, error)."""
    labels = ", ".join(repr(k) for k in V.LABELS)
    error = (
        "CASE WHEN coalesce(case_id, '') = '' THEN 'missing_id' "
        f"WHEN exists(segments, k -> k.label IS NOT NULL AND k.label NOT IN ({labels})) "
        "THEN 'unknown_label' "
        "WHEN exists(segments, k -> k.label IS NOT NULL AND coalesce(k.text, '') = '') "
        "THEN 'empty_annotation' "
        f"WHEN exists(groups, g -> NOT rlike(g, r'^{V.GROUP_NAME}\\z')) "
        "OR size(array_distinct(groups)) <> size(groups) THEN 'invalid_groups' END"
    )
    single = cases.select("case_id", F.expr(error).alias("error")).where("error IS NOT NULL")
    repeated = (
        cases.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1")
        .select("case_id", F.lit("duplicate_id").alias("error"))
    )
    return single.unionByName(repeated)
