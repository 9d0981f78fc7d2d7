"""Running totals over time without a single-task window.

Rows are first added up per instant. Instants are then summed by second and by day, and the running
total of an instant is the total of earlier days, of earlier seconds of its day and of earlier
instants of its second. Each window is bounded by the calendar (days; 86,400 seconds; one million
microseconds), however many rows share a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskwright.functions.spans import hold


def local_micros(ts: str) -> str:
    """Microseconds of a timestamp without time zone, whatever the zone of the session."""
    return (
        f"cast(cast(cast({ts} - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND) "
        "AS DECIMAL(18, 6)) * 1000000 AS bigint)"
    )


def running_totals(df: DataFrame, at: str, measures: dict[str, Column]) -> DataFrame:
    """For every instant of ``at``, each measure summed over all rows up to and including it."""
    names = list(measures)
    sums = [F.sum(n).alias(n) for n in names]
    local = dict(df.select(at).dtypes)[at] == "timestamp_ntz"
    micros = local_micros("instant") if local else "unix_micros(instant)"
    instants = df.groupBy(F.col(at).alias("instant")).agg(*[F.sum(c).alias(n) for n, c in measures.items()])
    # Held, so that no condition on the keys is pushed below: the branches then share one shuffle
    # of the aggregated rows, and the input is computed once.
    instants = hold(instants, {"_sec": f"{micros} - pmod({micros}, 1000000)"})
    instants = hold(instants, {"_day": "_sec - pmod(_sec, 86400000000)"})
    seconds = instants.groupBy("_day", "_sec").agg(*sums)
    days = seconds.groupBy("_day").agg(*sums)

    def before(window, prefix: str) -> list[Column]:
        frame = window.rowsBetween(W.unboundedPreceding, -1)
        return [F.coalesce(F.sum(n).over(frame), F.lit(0)).alias(prefix + n) for n in names]

    seconds = seconds.select("_sec", *before(W.partitionBy("_day").orderBy("_sec"), "s_"))
    days = days.select("_day", *before(W.partitionBy(F.lit(0)).orderBy("_day"), "d_"))
    inside = W.partitionBy("_sec").orderBy("instant").rowsBetween(W.unboundedPreceding, 0)
    return (
        instants.select("instant", "_sec", "_day", *[F.sum(n).over(inside).alias(n) for n in names])
        .join(seconds, "_sec")
        .join(days, "_day")
        .select("instant", *[(F.col(n) + F.col("s_" + n) + F.col("d_" + n)).alias(n) for n in names])
    )
