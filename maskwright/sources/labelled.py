"""Labelled datasets, baselines and reports as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright import fixed_values as V
from maskwright.operators import evaluate as E

_DATASET = (
    "schema_version int, description string, "
    "cases array<struct<id:string,groups:array<string>,segments:array<variant>>>"
)
_BASELINE = (
    "schema_version int, engine string, dataset_sha256 string, cases array<struct<id:string,"
    + ",".join(f"{c}:bigint" for c in ["true_positives", *V.ERROR_COUNTS])
    + ">>"
)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``case_id, groups, segments`` of a labelled dataset.

    A segment is a string, or an object with ``label`` and ``text``.
    """
    segment = (
        "CASE WHEN schema_of_variant(s) LIKE 'OBJECT%' "
        "THEN named_struct('label', coalesce(variant_get(s, '$.label', 'string'), ''), "
        "'text', variant_get(s, '$.text', 'string')) "
        "ELSE named_struct('label', cast(null AS string), 'text', cast(s AS string)) END"
    )
    files = spark.read.schema(_DATASET).json(path, multiLine=True, mode="FAILFAST")
    wrong = F.raise_error("expected a dataset of schema version 1 with cases")
    sound = F.expr(f"schema_version = {V.SCHEMA_VERSION} AND size(cases) > 0")
    return (
        files.select(F.explode(F.when(sound, F.col("cases")).otherwise(wrong)).alias("c"))
        .select(
            F.col("c.id").alias("case_id"),
            F.expr("coalesce(c.groups, cast(array() AS array<string>))").alias("groups"),
            F.expr(f"transform(c.segments, s -> {segment})").alias("segments"),
        )
    )


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file as it stands on disk."""
    return spark.read.format("binaryFile").load(path).select(
        "path", F.sha2("content", 256).alias("dataset_sha256")
    )


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BASELINE).json(path, multiLine=True, mode="FAILFAST").select(
        "schema_version", "engine", "dataset_sha256", F.inline("cases")
    ).withColumnRenamed("id", "case_id")


def stamp(report: DataFrame, engine: str, digest: str) -> DataFrame:
    """Add what a later comparison is checked against."""
    return report.withColumns(
        {
            "schema_version": F.lit(V.SCHEMA_VERSION),
            "engine": F.lit(engine),
            "dataset_sha256": F.lit(digest),
        }
    )


_PARTS = ("totals", "labels", "groups", "cases")
_MANIFEST = "schema_version int, engine string, dataset_sha256 string, case_count long, case_digest string"


def rows_digest(cases: DataFrame) -> DataFrame:
    """How many cases there are, and a hash of their rows that does not depend on their order.

    Row hashes are added up in two halves, so nothing is sorted or gathered; any row that is gone, new,
    repeated or changed gives another sum.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(cases.columns))), 256)
    halves = [F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16)]
    return cases.agg(F.count("*").alias("case_count"), F.sha2(F.concat_ws(":", F.count("*"), *halves), 256).alias("case_digest"))


def write_report_folder(scored: DataFrame, path: str, *, engine: str, digest: str) -> None:
    """A whole report of scored cases: totals, labels, groups and cases, each a table of its own below ``path``, and
    last a manifest of one row. A report without its manifest was not finished; no part holds source text.
    ``scored`` is read for each part, so hand over a stored table."""
    spark = scored.sparkSession
    for name, part in {"totals": E.totals(scored), "labels": E.by_label(scored), "groups": E.by_group(scored), "cases": E.case_rows(scored)}.items():
        write_report(part, f"{path}/{name}", "parquet")
    cases = spark.read.parquet(f"{path}/cases")
    manifest = stamp(rows_digest(cases), engine, digest).select(*[c.split()[0] for c in _MANIFEST.split(", ")])
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")


def read_report_folder(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts of a finished report, each with the head of its manifest. One that has no manifest, is of another
    schema version, or whose cases are not those that the manifest was written for, is refused."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").collect()
    if len(manifest) != 1 or manifest[0].schema_version != V.SCHEMA_VERSION:
        raise ValueError(f"expected a finished report of schema version {V.SCHEMA_VERSION}: {path}")
    head = manifest[0]
    parts = {name: spark.read.parquet(f"{path}/{name}") for name in _PARTS}
    if tuple(rows_digest(parts["cases"]).first()) != (head.case_count, head.case_digest):
        raise ValueError(f"the cases of the report are not those of its manifest: {path}")
    return {name: stamp(part, head.engine, head.dataset_sha256) for name, part in parts.items()}


def gate(spark: SparkSession, report: str, baseline: str) -> DataFrame:
    """Regressions of one stored report against another."""
    new, old = (read_report_folder(spark, p)["cases"] for p in (report, baseline))
    return E.regressions(new, old)


def write_report(report: DataFrame, path: str, format: str = "json") -> None:
    """Write a report. A column that could carry source text is refused."""
    held = {"text", "redacted_text", "match_text", "subject", "body"} & set(report.columns)
    if held:
        raise ValueError(f"a report must not contain source text: {sorted(held)}")
    report.write.mode("errorifexists").format(format).save(path)
