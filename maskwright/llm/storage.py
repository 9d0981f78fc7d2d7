"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from maskwright.sources.scratch import scratch_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to a fresh shared folder and read back: cuts the lineage, survives lost executors."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
