"""Plain texts, messages and reviewed exports as files and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators.prepare import accepted, reviewed_text

MESSAGE = (
    "message_id string, direction string, sender string, recipients array<string>, "
    "subject string, body string, sent_at timestamp"
)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, whole."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def read_messages(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Messages with a fixed schema. Lines that do not fit it keep ``_corrupt_record`` (JSON)."""
    if format == "json":
        schema = MESSAGE + ", _corrupt_record string"
        return spark.read.schema(schema).json(path, mode="PERMISSIVE")
    return spark.read.schema(MESSAGE).format(format).load(path)


def stream_messages(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """The same messages as they arrive in a folder."""
    return spark.readStream.schema(MESSAGE).format(format).options(**options).load(path)


def export_reviewed(prepared: DataFrame) -> DataFrame:
    """Accepted candidates as plain text, one row per request."""
    return accepted(prepared).select("request_id", F.expr(reviewed_text()).alias("reviewed_text"))


def write_reviewed(prepared: DataFrame, path: str) -> None:
    export_reviewed(prepared).write.mode("errorifexists").parquet(path)
