import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from maskwright.operators import dashboard as B
from maskwright.operators import mail as M
from maskwright.operators import prepare as P
from maskwright.operators import review
from maskwright.sources import scratch
from maskwright.sources import texts as X
from maskwright.sources.tables import Tables
from maskwright.streaming import live as L
from maskwright.streaming import receipts as R
from maskwright.streaming.run import drain, drain_changes, drain_totals

INSIDE = ["in.example"]
T0 = datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("messages") / "in")
    rows = [
        (f"m{i}", ["inbound", "outbound", "internal"][i % 3], "a@in.example", ["b@out.example" if i % 2 else "b@in.example"],
         "Greta Holm" if i % 4 == 0 else "", "mail carla@mail.example" if i % 5 else "", T0 + timedelta(minutes=7 * i))
        for i in range(60)
    ]
    df = spark.createDataFrame(rows, X.MESSAGE)
    for k in range(3):
        df.where(F.col("sent_at") >= T0 + timedelta(minutes=140 * k)).where(
            F.col("sent_at") < T0 + timedelta(minutes=140 * (k + 1))
        ).coalesce(1).write.mode("append").parquet(path)
    return path


def scanned(spark, folder):
    return M.scan_all(X.read_messages(spark, folder, "parquet"), INSIDE)


def live(spark, folder):
    return L.live_scan(X.stream_messages(spark, folder, maxFilesPerTrigger=1), INSIDE)


def as_set(df):
    return {tuple(sorted(r.asDict().items())) for r in df.collect()}


def test_batch_and_stream_agree(spark, folder):
    batch = scanned(spark, folder)
    assert as_set(drain_totals(L.live_counters(live(spark, folder)), "t")) == as_set(B.counters(batch))
    assert as_set(drain_totals(L.live_label_totals(live(spark, folder)), "l")) == as_set(B.label_totals(batch))
    cols = ["message_id", "span_count", "risk", "body_redacted"]
    assert as_set(drain(live(spark, folder).select(cols), "s")) == as_set(batch.select(cols))
    alerts = drain(L.alerts(live(spark, folder)), "a")
    assert {r.message_id for r in alerts.collect()} == {r.message_id for r in M.view(batch, "leaks").collect()}


def test_every_run_starts_from_zero(spark, folder):
    first = drain_totals(L.live_counters(live(spark, folder)), "r").first()
    assert drain_totals(L.live_counters(live(spark, folder)), "r").first() == first


def test_windows_and_sessions(spark, folder):
    batch = scanned(spark, folder)
    hours = {r.start: r.total for r in batch.groupBy(F.window("sent_at", "1 hour").start.alias("start")).agg(F.count("*").alias("total")).collect()}
    got = {r.start: r.total for r in drain_totals(L.windowed_counters(live(spark, folder), "1 hour"), "w").collect()}
    assert got == hours
    closed = {r.start: r.total for r in drain(L.windowed_counters(live(spark, folder), "1 hour"), "wa").collect()}
    assert closed == {s: n for s, n in hours.items() if s + timedelta(hours=1) <= T0 + timedelta(minutes=7 * 59 - 10)}
    (session,) = drain_totals(L.sender_sessions(live(spark, folder)), "x").collect()
    assert session.total == 60 and session.sender == "a@in.example"


ATTEMPT = "event_id bigint, occurred_at timestamp, action string, token string, fingerprint string, confirmed boolean"


def attempt_files(spark, path, rows, files):
    """A log in ``files`` files, one micro-batch each."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    step = -(-len(rows) // files)
    for k in range(0, len(rows), step):
        spark.createDataFrame(rows[k : k + step], ATTEMPT).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_receipts_expire_and_export_once(spark, tmp_path):
    p = [("a", 0, "1"), ("b", 0, "1"), ("c", 0, "1"), ("d", 0, "1"), ("e", 0, "1"), ("e", 1, "2"), ("late", 90_000, "1")]
    x = [("a", 599, "1", True), ("a", 599, "1", True), ("b", 600, "1", True), ("c", 5, "2", True), ("d", 5, "1", False), ("e", 9, "2", True), ("late", 90_001, "2", True)]
    rows = [(i, T0 + timedelta(seconds=s), "prepared", t, f, None) for i, (t, s, f) in enumerate(p)]
    rows += [(100 + i, T0 + timedelta(seconds=s), "exported", t, f, c) for i, (t, s, f, c) in enumerate(x)]
    rows += [(200, T0, "prepared", None, "1", None), (201, T0, "prepared", "n", None, None), (202, T0 + timedelta(seconds=1), "exported", "n", None, True)]
    receipts = R.latest(drain_changes(R.receipt_changes(attempt_files(spark, str(tmp_path / "a"), rows, 2)), "v"))
    assert [(r.token, r.use_event) for r in R.exported(receipts).collect()] == [("a", "100")]
    assert sorted(r.token for r in R.unexported(receipts).collect()) == ["b", "c", "d", "e", "late", "n"]


@pytest.mark.parametrize("files", [1, 5])
def test_receipts_of_stream_and_batch_agree(spark, tmp_path, files):
    rng = random.Random(files)
    rows = [
        (i, T0 + timedelta(seconds=rng.randrange(900)), rng.choice(["prepared", "exported", "exported", "discarded"]),
         rng.choice(["hot"] * 5 + [f"t{k}" for k in range(60)]), rng.choice("12"), rng.choice([True, True, False, None]))
        for i in range(500)
    ]
    stream = attempt_files(spark, str(tmp_path / "a"), rows, files)
    got = {(r.token, int(r.issue_event), r.use_event and int(r.use_event), r.use_action) for r in R.latest(drain_changes(R.receipt_changes(stream, 200), "r")).collect()}
    batch = review.receipts(spark.createDataFrame(rows, ATTEMPT), 200)
    expected = {(r.token, r.issue.event_id, r.use and r.use.event_id, r.use_action) for r in batch.collect()}
    assert got == expected and {"exported", "discarded", None} == {r[3] for r in got}


def test_a_stream_reads_a_table_of_many_files(spark, tmp_path):
    source = Tables(spark, "/root/testdata/sf0.001")
    source.read("orders").repartition(5).write.parquet(str(tmp_path / "orders.parquet"))
    rows = drain(Tables(spark, str(tmp_path)).message_stream().select("message_id"), "m")
    assert rows.count() == source.read("orders").count()


def test_scratch_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch.scratch_folder(spark, "x").startswith(root)
    assert scratch.scratch_folder(spark, "x") != scratch.scratch_folder(spark, "x")


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.txt").write_text("line one\nline two 😀", encoding="utf-8")
    (row,) = X.read_texts(spark, str(tmp_path / "t")).collect()
    assert row.text == "line one\nline two 😀" and row.path.endswith("one.txt")

    good = {"message_id": "1", "direction": "inbound", "sender": "a", "recipients": ["b"], "subject": "s", "body": "b", "sent_at": "2024-05-01T10:00:00Z"}
    (tmp_path / "m.json").write_text(json.dumps(good) + "\n" + json.dumps({**good, "recipients": "b"}) + "\n{broken\n")
    rows = X.read_messages(spark, str(tmp_path / "m.json")).cache().collect()
    assert [r._corrupt_record is None for r in rows] == [True, False, False]
    assert rows[0].sent_at == datetime(2024, 5, 1, 10)

    requests = spark.createDataFrame(
        [("1", "email", {"sender": "a@b.co", "recipients": "c@d.ef", "subject": "S", "body": "B"}, None), ("2", "ai_prompt", {"text": "T"}, None), ("3", "ai_prompt", {"text": ""}, None)],
        f"request_id string, use_case string, fields map<string,string>, manual_masks {P.MASKS}",
    )
    X.write_reviewed(P.prepare(requests), str(tmp_path / "out"))
    got = {r.request_id: r.reviewed_text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"1": "Sender: [SENDER_REMOVED]\n\nRecipients: [RECIPIENTS_REMOVED]\n\nSubject: S\n\nBody: B", "2": "T"}
