"""Streams that free their state: receipts with timers, the interval join, merged windows, late rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from maskwright.operators import review
from maskwright.sources.scratch import scratch_folder
from maskwright.streaming import expiring as E
from maskwright.streaming import live as L
from maskwright.streaming import run

T0 = datetime(2024, 5, 1)
ATTEMPT = "event_id bigint, occurred_at timestamp, action string, token string, fingerprint string, confirmed boolean"
END = [(9_999, T0 + timedelta(days=2), "discarded", "the end", None, None)]


def stream(spark, path, batches):
    """Each list of rows is a file, and a micro-batch of its own."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ATTEMPT).coalesce(1).write.parquet(f"{path}/part={k:03d}")
    return spark.readStream.schema(ATTEMPT).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/part=*")


def attempts(seed, n, seconds, tokens=60):
    rng = random.Random(seed)
    return [
        (i, T0 + timedelta(seconds=rng.randrange(seconds)), rng.choice(["prepared", "exported", "exported", "discarded"]),
         rng.choice(["hot"] * 8 + [f"t{k}" for k in range(tokens)]), rng.choice(["1", "1", "2", None]), rng.choice([True, True, False, None]))
        for i in range(n)
    ]


def batch_rows(spark, rows, life):
    """Receipts as the batch decides them, none of which is open at the end of time."""
    found = review.receipts(spark.createDataFrame(rows, ATTEMPT).where("token IS NOT NULL AND token <> 'the end'"), life).collect()
    return {(r.token, str(r.issue.event_id), r.use and str(r.use.event_id), r.use_action or "expired") for r in found}


@pytest.mark.parametrize("parts", [1, 6])
def test_closed_receipts_are_those_of_the_batch(spark, tmp_path, parts):
    """Attempts in time order are cut into batches, then shuffled inside the lateness."""
    rng = random.Random(parts)
    rows = attempts(parts, 900, 6000, 40) + [(9700 + k, T0 + timedelta(seconds=k), "prepared", None, "1", None) for k in range(3)]
    late = sorted(rows, key=lambda r: (r[1] + timedelta(seconds=rng.randrange(500)), r[0]))
    step = -(-len(late) // parts)
    batches = [late[k : k + step] for k in range(0, len(late), step)] + [END]
    closed = run.drain(E.closed_receipts(stream(spark, str(tmp_path / "a"), batches), 600, "10 minutes"), "closed")
    first = E.first_receipts(closed).collect()
    got = {(r.token, r.issue_event, r.use_event, r.use_action) for r in first}
    assert got == batch_rows(spark, rows, 600) and {"exported", "discarded", "expired"} == {r[3] for r in got}
    assert all((r.use_at is None) == (r.use_action == "expired") for r in first)


def test_the_life_ends_at_its_last_second(spark, tmp_path):
    p = [("a", 0), ("b", 0), ("c", 0), ("d", 0)]
    rows = [(k, T0 + timedelta(seconds=s), "prepared", t, "1", None) for k, (t, s) in enumerate(p)]
    rows += [(10, T0 + timedelta(seconds=599), "exported", "a", "1", True), (11, T0 + timedelta(seconds=600), "exported", "b", "1", True)]
    rows += [(12, T0 + timedelta(seconds=5), "exported", "c", "2", True), (13, T0 + timedelta(seconds=9), "exported", "c", "1", True)]
    closed = run.drain(E.closed_receipts(stream(spark, str(tmp_path / "a"), [rows, END])), "closed")
    assert {(r.token, r.use_event, r.use_action) for r in closed.collect()} == {("a", "10", "exported"), ("b", None, "expired"), ("c", "13", "exported"), ("d", None, "expired")}


def test_state_falls_to_the_open_receipts(spark, tmp_path):
    batches = [[(100 * h + k, T0 + timedelta(hours=h, seconds=k), "prepared", f"t{h}-{k}", "1", None) for k in range(50)] for h in range(6)]
    query = (
        E.closed_receipts(stream(spark, str(tmp_path / "a"), batches)).writeStream.foreachBatch(lambda df, n: df.count() and None)
        .option("checkpointLocation", scratch_folder(spark, "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # of six hours with 50 receipts each, the last hour's are open: value, list and timer rows of these
    assert rows and rows[-1] <= 4 * 50 and max(rows) <= 9 * 50


def ordered(seed, tokens):
    """Receipts prepared once, then exported some times, all rows in time order."""
    rng = random.Random(seed)
    rows = []
    for k in range(tokens):
        at = rng.randrange(20_000)
        rows.append((T0 + timedelta(seconds=at), "prepared", f"t{k}", "1", None))
        for _ in range(rng.randrange(4)):
            rows.append((T0 + timedelta(seconds=at + 1 + rng.randrange(900)), "exported", f"t{k}", rng.choice("112"), rng.choice([True, True, None])))
    rows.sort(key=lambda r: (r[0], r[2]))
    return [(i, *r) for i, r in enumerate(rows)]


def test_interval_join_is_the_batch_on_ordered_input(spark, tmp_path):
    rows = ordered(3, 120)
    batches = [rows[k : k + 60] for k in range(0, len(rows), 60)]
    end = [(10_000 + k, T0 + timedelta(days=2), a, "the end", "9", True) for k, a in enumerate(("prepared", "exported"))]
    path = str(tmp_path / "a")
    first = stream(spark, path, [*batches, end])
    again = lambda: spark.readStream.schema(ATTEMPT).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")
    got = run.drain(E.valid_exports(first, again()), "joined").collect()
    want = {(r.token, r.use.event_id) for r in review.receipts(spark.createDataFrame(rows, ATTEMPT)).where("use_action = 'exported'").collect()}
    got = [r for r in got if r.token != "the end"]
    assert {r.token for r in got} == {t for t, _ in want} and len(got) == len(want) > 20
    missed = run.drain(E.unexported(again(), again()), "missed").collect()
    assert {r.token for r in missed} - {"the end"} == {f"t{k}" for k in range(120)} - {t for t, _ in want}


def test_late_rows_have_a_table(spark, tmp_path):
    batches = [[(1, T0, "prepared", "a", "1", None), (2, T0 + timedelta(hours=1), "prepared", "b", "1", None)],
               [(6, T0 + timedelta(minutes=59), "exported", "b", "1", True)],
               [(3, T0 + timedelta(minutes=49), "prepared", "late", "1", None), (4, T0 + timedelta(minutes=50), "prepared", "edge", "1", None), (5, T0 + timedelta(minutes=51), "prepared", "c", "1", None)]]
    source = stream(spark, str(tmp_path / "a"), batches)
    late = run.late_rows(source, "occurred_at", "10 minutes", "late")
    assert sorted(r.event_id for r in late.collect()) == [3, 4]
    again = spark.readStream.schema(ATTEMPT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/a/part=*")
    kept = run.drain(again.withWatermark("occurred_at", "10 minutes").dropDuplicates(["event_id", "occurred_at"]).select("event_id"), "kept")
    assert sorted(r.event_id for r in kept.collect()) == [1, 2, 5, 6]


def test_merged_windows_are_the_batch_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows = sorted(attempts(5, 400, 30_000), key=lambda r: r[1])
    source = stream(spark, str(tmp_path / "a"), [rows[k : k + 50] for k in range(0, 400, 50)])
    windows = source.withWatermark("occurred_at", L.LATENESS).groupBy(F.window("occurred_at", "1 hour").start.alias("w")).agg(F.count("*").alias("n"))
    out, done = run._batches(windows, "w", "update")
    want = {(r.w, r.n) for r in spark.createDataFrame(rows, ATTEMPT).groupBy(F.window("occurred_at", "1 hour").start.alias("w")).agg(F.count("*").alias("n")).collect()}
    assert len(done) >= 8 and {tuple(r) for r in run.merged(spark, out, windows, ["w"]).collect()} == want
    again = spark.read.schema(windows.schema).parquet(f"{out}/batch={done[2]}").collect()
    spark.createDataFrame(again, windows.schema).write.mode("overwrite").parquet(f"{out}/batch={done[2]}")
    assert {tuple(r) for r in run.merged(spark, out, windows, ["w"]).collect()} == want
    nothing = run.drain_merged(stream(spark, str(tmp_path / "b"), [[]]).groupBy("token").count(), "none", ["token"])
    assert nothing.count() == 0
