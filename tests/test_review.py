import hashlib
import hmac
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from maskwright.functions.hmac import hmac_sha256
from maskwright.operators import review as R

T0 = datetime(2024, 5, 1)
SCHEMA = (
    "event_id int, occurred_at timestamp, action string, token string, fingerprint string, confirmed boolean, "
    "use_case string, engine string, span_count int, manual_mask_count int"
)


def log(spark, rows):
    return spark.createDataFrame(
        [(i, T0 + timedelta(seconds=s), a, t, f, c, "email", "heuristic", 1, 0) for i, (s, a, t, f, c) in enumerate(rows)], SCHEMA
    )


def outcomes(spark, rows, **options):
    done = R.reconcile(log(spark, rows), **options).collect()
    return [r.outcome for r in sorted(done, key=lambda r: r.event_id)]


def test_life_of_a_receipt(spark):
    p, x, d = "prepared", "exported", "discarded"
    rows = [
        (0, p, "a", "1", None), (5, x, "a", "2", True), (6, x, "a", "1", False), (7, x, "a", "1", None), (8, x, "a", "1", True), (9, x, "a", "1", True), (9, d, "a", None, None),
        (0, p, "b", "1", None), (600, x, "b", "1", True),
        (0, p, "c", "1", None), (599, x, "c", "1", True),
        (0, p, "d", "1", None), (1, d, "d", None, None), (2, d, "d", None, None), (3, x, "d", "1", True),
        (1, x, "e", "1", True), (1, d, "e", None, None), (2, p, "e", "1", None), (3, p, "e", "1", None), (4, x, "e", "1", True),
        (0, p, "f", "1", None), (0, x, "f", "1", True), (0, x, "f", "1", True),
        (0, p, "g", "1", None), (700, d, "g", None, None), (701, x, "g", "2", True),
    ]
    assert outcomes(spark, rows) == [
        "prepared", "candidate_changed", "review_required", "review_required", "exported", "review_unavailable", "ignored",
        "prepared", "review_unavailable",
        "prepared", "exported",
        "prepared", "discarded", "ignored", "review_unavailable",
        "review_unavailable", "ignored", "prepared", "duplicate_receipt", "exported",
        "prepared", "exported", "review_unavailable",
        "prepared", "ignored", "review_unavailable",
    ]


def simulate(rows, life):
    pending, seen, out = {}, set(), {}
    for i, (s, action, token, print_, confirmed) in sorted(enumerate(rows), key=lambda r: (r[1][0], r[0])):
        live = token in pending and s < pending[token][0]
        if action == "prepared":
            out[i] = "duplicate_receipt" if token in seen else "prepared"
            if token not in seen:
                pending[token] = (s + life, print_)
            seen.add(token)
        elif action == "discarded":
            out[i] = "discarded" if live else "ignored"
            if live:
                del pending[token]
        elif not confirmed:
            out[i] = "review_required"
        elif not live:
            out[i] = "review_unavailable"
        elif print_ != pending[token][1]:
            out[i] = "candidate_changed"
        else:
            out[i] = "exported"
            del pending[token]
    return [out[i] for i in range(len(rows))]


def test_random_logs_match_a_step_by_step_store(spark):
    rng = random.Random(11)
    rows = [
        (rng.randrange(900), rng.choice(["prepared", "exported", "exported", "discarded"]),
         rng.choice(["hot"] * 10 + [f"t{k}" for k in range(40)]), rng.choice("12"), rng.choice([True, True, False, None]))
        for _ in range(800)
    ]
    rows = [(s, a, t, "1" if a == "prepared" else f, c) for s, a, t, f, c in rows]
    assert outcomes(spark, rows, life_seconds=200) == simulate(rows, 200)


def test_backlog_and_limit(spark):
    rows = [(i, "prepared", f"t{i}", "1", None) for i in range(256)] + [(300, "exported", "t0", "1", True), (301, "discarded", "t1", None, None)]
    gauge = {r.instant: (r.open, r.full) for r in R.backlog(log(spark, rows)).collect()}
    at = lambda s: gauge[T0 + timedelta(seconds=s)]
    assert at(254) == (255, False) and at(255) == (256, True) and at(300) == (255, False) and at(301) == (254, False)
    assert at(602) == (253, False) and at(855) == (0, False)


def test_audit_rows_hold_no_content(spark):
    rows = [(i, "prepared", f"t{i}", "1", None) for i in range(130)] + [(131, "exported", "t0", "wrong", True)]
    events = R.audit_events(R.reconcile(log(spark, rows)))
    assert set(events.columns) == {"event_id", "occurred_at", "actor", "action", "use_case", "engine", "policy_version", "span_count", "manual_mask_count"}
    last = R.last_events(events).collect()
    assert [r.event_id for r in last] == list(range(129, 1, -1))


def test_keyed_fingerprints(spark):
    texts = ["", "abc", "😀 Åsa", "x" * 500]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for key in (b"k", b"key" * 50):
        got = [r[0] for r in df.select(F.expr(hmac_sha256("t", key))).collect()]
        assert got == [hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts]


def test_a_changed_candidate_is_not_released(spark):
    fields = {"sender": "x", "text": "shared"}
    row = [(str(i), "ai_prompt", "heuristic", "v", fields, None, "too bad" if i == 3 else None) for i in range(4)]
    routing = "struct<recipient_count:int,crosses_boundary:boolean,all_recipients_internal:boolean>"
    prepared = spark.createDataFrame(row, f"request_id string, use_case string, engine string, policy_version string, candidate_fields map<string,string>, routing {routing}, reject_reason string")
    issued = R.issue(prepared, b"k", token=F.concat(F.lit("t"), "request_id"), issued_at=F.lit(T0))
    assert {(r.token, (r.expires - r.issued_at).seconds) for r in issued.collect()} == {("t0", 600), ("t1", 600), ("t2", 600)}
    events = R.issue_events(issued, F.col("request_id").cast("int"))
    tries = events.withColumns({"event_id": F.col("event_id") + 10, "action": F.lit("exported"), "confirmed": F.col("token") != "t1"})
    decided = R.reconcile(events.unionAll(tries).unionAll(tries.withColumn("event_id", F.col("event_id") + 10)))
    assert [(r.token, r.export_event) for r in R.export(issued, decided, b"k").orderBy("token").collect()] == [("t0", 10), ("t2", 12)]
    # a token that was issued twice is released once, and only as it was issued first
    later = issued.withColumns({"issued_at": F.expr("issued_at + INTERVAL 1 SECOND"), "use_case": F.lit("email")})
    for twice in (issued.unionAll(issued), issued.unionAll(later), later.unionAll(issued)):
        assert [(r.token, r.use_case) for r in R.export(twice, decided, b"k").orderBy("token").collect()] == [("t0", "ai_prompt"), ("t2", "ai_prompt")]
    edited = issued.withColumn("candidate_fields", F.expr("CASE WHEN token = 't0' THEN map('sender', 'x', 'text', 'edited') ELSE candidate_fields END"))
    assert [r.token for r in R.export(edited, decided, b"k").collect()] == ["t2"]
