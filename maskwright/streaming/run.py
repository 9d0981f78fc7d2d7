"""Run a stream over what is there now and hand back its output as a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.sources.scratch import scratch_folder


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input in append mode into a fresh table and read it back."""
    spark = stream.sparkSession
    out = scratch_folder(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", scratch_folder(spark, name + "-state"))
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _batches(stream: DataFrame, name: str, mode: str) -> tuple[str, list[int]]:
    """Every micro-batch as a folder of its own, written anew if it is repeated; the folder and the numbers."""
    spark = stream.sparkSession
    out, done = scratch_folder(spark, name), []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        done.append(number)

    query = (
        stream.writeStream.foreachBatch(keep)
        .outputMode(mode)
        .option("checkpointLocation", scratch_folder(spark, name + "-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return out, done


def drain_totals(stream: DataFrame, name: str) -> DataFrame:
    """The final rows of an aggregate in complete mode: counters, labels, and windows, open ones included."""
    spark = stream.sparkSession
    out, done = _batches(stream, name, "complete")
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/batch={done[-1]}")


def drain_merged(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """The present rows of an aggregate in update mode: of each key that of the last batch that changed it.

    A batch stores what it changed, under its own number: one that is run again replaces itself, and no
    batch reads or writes what others stored.
    """
    spark = stream.sparkSession
    out, done = _batches(stream, name, "update")
    return merged(spark, out, stream, keys) if done else spark.createDataFrame([], stream.schema)


def merged(spark: SparkSession, out: str, like: DataFrame, keys: list[str]) -> DataFrame:
    """The stored changes of all batches below ``out``, merged."""
    schema = T.StructType([*like.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(out)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*like.columns), "batch").alias("r")).select("r.*")


def late_rows(stream: DataFrame, time: str, lateness: str, name: str) -> DataFrame:
    """The rows that a watermark on ``time`` leaves out. A batch leaves out what the watermark of the batch before
    it had passed: that is the newest time of all batches before that one, less ``lateness``. Each batch
    stores its newest time and its late rows under its own number."""
    spark = stream.sparkSession
    out = scratch_folder(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        newest = batch.agg(F.max(time).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{out}/newest/batch={number}")
        seen = spark.read.schema("newest timestamp, batch long").parquet(f"{out}/newest").where(F.col("batch") < number - 1)
        (mark,) = seen.agg(F.expr(f"date_trunc('MILLISECOND', max(newest)) - INTERVAL {lateness}")).first()
        late = batch.where(F.lit(False) if mark is None else F.col(time) <= F.lit(mark))
        late.write.mode("overwrite").parquet(f"{out}/late/batch={number}")

    query = (
        stream.writeStream.foreachBatch(keep)
        .option("checkpointLocation", scratch_folder(spark, name + "-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(f"{out}/late").drop("batch")


def drain_changes(stream: DataFrame, name: str) -> DataFrame:
    """All rows that an update-mode stream gave, batch after batch."""
    spark = stream.sparkSession
    out, done = _batches(stream, name, "update")
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{out}/batch={n}" for n in sorted(set(done))])
