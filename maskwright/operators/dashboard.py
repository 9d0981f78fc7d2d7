"""Dashboard figures over scanned and classified messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskwright import fixed_values as V
from maskwright.operators.running import running_totals

COUNTERS = {
    "total": "true",
    "inbound": "direction = 'inbound'",
    "outbound": "direction = 'outbound'",
    "internal": "direction = 'internal'",
    "sensitive": "is_sensitive",
    "sensitive_inbound": "is_sensitive AND direction = 'inbound'",
    "sensitive_outbound": "is_sensitive AND direction = 'outbound'",
    "sensitive_internal": "is_sensitive AND direction = 'internal'",
    "crossing_boundary": "crosses_boundary",
    "leaks_out": "leak_risk",
}


def counter_columns() -> list[Column]:
    return [F.expr(f"count_if({cond})").alias(name) for name, cond in COUNTERS.items()]


def counters(assessed: DataFrame) -> DataFrame:
    """All message counters in one pass; one row."""
    return assessed.agg(*counter_columns())


def label_totals(assessed: DataFrame) -> DataFrame:
    return (
        assessed.select(F.explode("by_label").alias("label", "n"))
        .groupBy("label")
        .agg(F.sum("n").alias("n"))
    )


def label_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(V.LABEL_ORDER)), "rank int, label string")


def kpis(assessed: DataFrame) -> DataFrame:
    """Headline figures: spans, label categories present and the sensitive share in percent."""
    present = [
        F.max(F.expr(f"cast(map_contains_key(by_label, '{k}') AS int)")).alias(f"_{k}")
        for k in V.LABELS
    ]
    categories = " + ".join(f"coalesce(_{k}, 0)" for k in V.LABELS)
    return assessed.agg(
        *counter_columns(), F.coalesce(F.sum("span_count"), F.lit(0)).alias("spans"), *present
    ).select(
        "total",
        "sensitive",
        "leaks_out",
        "sensitive_inbound",
        "crossing_boundary",
        "spans",
        F.expr(f"cast({categories} AS bigint)").alias("categories"),
        F.expr(
            "CASE WHEN total = 0 THEN 0L ELSE cast(floor(sensitive * 100 / total + 0.5) AS bigint) END"
        ).alias("sensitive_percent"),
    )


def splits(figures: DataFrame) -> DataFrame:
    """The three two-way splits, from a row of counters."""
    return figures.selectExpr(
        "stack(3, 'sensitive', sensitive, greatest(0L, total - sensitive), "
        "'leaks', leaks_out, greatest(0L, outbound - leaks_out), "
        "'inside', greatest(0L, total - crossing_boundary), crossing_boundary) "
        "AS (split, left_count, right_count)"
    )


def label_bars(totals: DataFrame) -> DataFrame:
    """Every label with its count and its share of the largest count, in percent."""
    bars = (
        label_list(totals.sparkSession)
        .join(totals, "label", "left")
        .select("rank", "label", F.coalesce("n", F.lit(0)).alias("n"))
    )
    # eight rows, one per label
    return bars.select(
        "label",
        "n",
        (F.col("n") * 100 / F.greatest(F.lit(1), F.max("n").over(W.partitionBy(F.lit(0))))).alias("width"),
    )


def crosstab(assessed: DataFrame) -> DataFrame:
    """Spans by direction and label with all totals, in one pass. A total is ``*``, a null direction stays null."""
    return (
        assessed.select("direction", F.explode("by_label").alias("label", "n"))
        .cube("direction", "label")
        .agg(F.sum("n").alias("n"), F.grouping("direction").alias("_all"), F.grouping("label").alias("_any"))
        .select(
            F.when(F.col("_all") == 1, "*").otherwise(F.col("direction")).alias("direction"),
            F.when(F.col("_any") == 1, "*").otherwise(F.col("label")).alias("label"),
            "n",
        )
    )


def running_counters(assessed: DataFrame) -> DataFrame:
    """The counters as they stood after each instant at which messages arrived."""
    measures = {n: F.expr(f"cast({cond} AS int)") for n, cond in COUNTERS.items()}
    measures["spans"] = F.col("span_count")
    return running_totals(assessed, "sent_at", measures)
