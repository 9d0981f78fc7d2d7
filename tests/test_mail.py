import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from maskwright.operators import dashboard as B
from maskwright.operators import directory as P
from maskwright.operators import mail as M
from maskwright.operators.running import running_totals

INSIDE = ["in.example", "also-in.example"]
SCHEMA = "message_id int, direction string, sender string, recipients array<string>, subject string, body string, sent_at timestamp"


def messages(spark, rows):
    t0 = datetime(2024, 5, 1)
    return spark.createDataFrame([(i, *r, t0 + timedelta(minutes=i)) for i, r in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize(
    "sender,recipients,crosses,outside",
    [
        ("a@in.example", ["b@in.example"], False, []),
        ("a@in.example", ["b@out.example"], True, ["out.example"]),
        ("a@out.example", ["b@in.example"], True, ["out.example"]),
        ("a@out.example", ["b@far.example"], False, ["far.example", "out.example"]),
        ("a@out.example", ["b@in.example", "c@far.example"], True, ["far.example", "out.example"]),
        ("a@in.example", ["b@in.example", "c@far.example", "d@far.example"], True, ["far.example"]),
        ("a@IN.EXAMPLE", ["b@also-in.example"], False, []),
        ("a@in.example", [], False, []),
        ("a@out.example", [], False, ["out.example"]),
        ("nobody", ["x@y@in.example"], True, [""]),
    ],
)
def test_boundary(spark, sender, recipients, crosses, outside):
    r = M.classify(messages(spark, [("inbound", sender, recipients, "", "")]), INSIDE).first()
    inside = [a.rsplit("@")[-1].lower() in INSIDE for a in recipients]
    assert (r.crosses_boundary, r.external_domains) == (crosses, outside)
    assert r.all_recipients_internal == (bool(inside) and all(inside))
    assert r.any_recipient_internal == any(inside)
    assert r.fully_internal == (r.sender_internal and r.all_recipients_internal)


@pytest.fixture(scope="module")
def assessed(spark):
    rows = [
        ("outbound", "a@in.example", ["b@out.example"], "Greta Holm", "mail carla@mail.example, token=abcdefgh"),
        ("outbound", "a@in.example", ["b@in.example"], "clean", "mail carla@mail.example"),
        ("inbound", "a@out.example", ["b@in.example"], "Abc Def", ""),
        ("internal", "a@in.example", ["b@in.example"], "", "nothing here"),
        ("outbound", "a@in.example", ["b@out.example"], "", ""),
    ]
    return M.scan_all(messages(spark, rows), INSIDE).cache()


def test_scan_and_risk(assessed):
    rows = {r.message_id: r for r in assessed.collect()}
    assert [rows[i].risk for i in range(5)] == ["Risk", "Sensitive", "Sensitive", "No findings", "No findings"]
    assert rows[0].by_label == {"private_email": 1, "private_person": 1, "secret": 1}
    assert rows[0].labels_by_priority == ["secret", "private_person", "private_email"]
    assert [rows[i].top_label for i in range(4)] == ["secret", "private_email", "private_person", "secret"]
    assert rows[0].subject_redacted == "[PRIVATE_PERSON]" and rows[0].body_redacted == "mail [PRIVATE_EMAIL], [SECRET]"


def test_dashboard(spark, assessed):
    c = B.counters(assessed).first().asDict()
    assert c == {"total": 5, "inbound": 1, "outbound": 3, "internal": 1, "sensitive": 3, "sensitive_inbound": 1,
                 "sensitive_outbound": 2, "sensitive_internal": 0, "crossing_boundary": 3, "leaks_out": 1}
    k = B.kpis(assessed).first()
    assert (k.spans, k.categories, k.sensitive_percent) == (5, 3, 60)
    assert B.kpis(assessed.where("false")).first().sensitive_percent == 0
    bars = {r.label: (r.n, r.width) for r in B.label_bars(B.label_totals(assessed)).collect()}
    assert len(bars) == 8 and bars["private_email"] == (2, 100.0) and bars["private_url"] == (0, 0.0)
    splits = {r.split: (r.left_count, r.right_count) for r in B.splits(B.counters(assessed)).collect()}
    assert splits == {"sensitive": (3, 2), "leaks": (1, 2), "inside": (2, 3)}
    last = B.running_counters(assessed).orderBy(F.desc("instant")).first().asDict()
    assert {n: last[n] for n in c} == c and last["spans"] == 5


def test_views_and_listings(assessed):
    counts = {v: M.view(assessed, v).count() for v in [*M.VIEWS, "anything else"]}
    assert counts == {"all": 5, "sensitive": 3, "leaks": 1, "inbound": 1, "outbound": 3, "internal": 1, "anything else": 5}
    assert [r.message_id for r in M.newest_first(assessed).collect()] == [4, 3, 2, 1, 0]
    assert M.by_id(assessed, 2).first().subject == "Abc Def"


def test_names_and_coverage(spark, assessed):
    df = spark.createDataFrame([("ann.b-cole_x@h.example",), ("x" * 38,), ("y" * 39,), ("",)], "a string")
    rows = df.select(F.expr(M.display_name("a")), F.expr(M.shorten("a"))).collect()
    assert rows[0][0] == "Ann B Cole X" and rows[3][0] == ""
    assert rows[1][1] == "x" * 38 and rows[2][1] == "y" * 36 + "…"
    twice = assessed.where("message_id > 0").unionAll(assessed.where("message_id = 3"))
    gaps = {(g.message_id, g.expected, g.scanned) for g in M.coverage_gaps(assessed, twice).collect()}
    assert gaps == {(0, 1, 0), (3, 1, 2)}


def test_directory_routes_agree_with_a_plain_search(spark, monkeypatch):
    rng = random.Random(5)
    names = ["Bo", "Åsa Ek", "Supplier#000000012", "supplier#000000013", "x", "Greta Holm"]
    people = [(i, n, f"p{i}@in.example", None if i == 2 else "r") for i, n in enumerate(names)]
    people.append((6, None, "", "r"))
    staff = spark.createDataFrame(people + people[:2], "staff_ord int, name string, email string, role string")
    bits = ["bo ", "BOB", "åsa ek", "SUPPLIER#000000012", "Supplier#00000001", "P3@IN.example", "greta  holm", "Greta Holm", "😀", "-" * 300]
    rows = [("inbound", "a", ["b"], rng.choice(bits), "".join(rng.choice(bits) for _ in range(rng.randint(0, 5)))) for _ in range(60)]
    df = messages(spark, rows)
    expected = set()
    for i, (_, _, _, subject, body) in enumerate(rows):
        low = f"{body} {subject}".lower()
        for ord_, name, email, _ in people:
            for kind, needle in (("name", name), ("email", email)):
                if needle and needle.lower() in low:
                    expected.add((i, ord_, kind, low.index(needle.lower())))
    assert expected

    def found(df=df):
        return [(r.message_id, r.staff_ord, r.kind, r.start) for r in P.mentions(df, staff).collect()]

    schemas = set()

    for limits in [(64, 200_000), (0, 200_000), (0, 1)]:
        monkeypatch.setattr(P, "IN_ROW_LIMIT", limits[0])
        monkeypatch.setattr(P, "BROADCAST_LIMIT", limits[1])
        got = found()
        assert len(got) == len(set(got)) and set(got) == expected
        assert sorted(found(df.unionAll(df))) == sorted(got + got)
        schemas.add(str([(f.name, f.dataType) for f in P.mentions(df, staff).schema]))
    assert len(schemas) == 1
    assert P.mentions(df, staff.where("false")).count() == 0


def test_few_fragments_pass_the_filter(spark):
    """What is joined with the directory is a few times what is there, not every part of every text."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
    names = [f"{word()} {word()}" for _ in range(3000)]
    texts = [" ".join(rng.choice(names) if rng.random() < 0.02 else word() for _ in range(100)) for _ in range(60)]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "_key string, _text string")
    keyed = spark.createDataFrame([(n[:8],) for n in names], "fragment string")
    got = {(r._key, r.fragment) for r in P.fragment_candidates(df, keyed, [8]).collect()}
    true = {(str(k), n[:8]) for k, t in enumerate(texts) for n in names if n[:8] in t}
    assert true <= got and len(got) < 3 * len(true) + 0.02 * sum(map(len, texts))
    assert P.fragment_candidates(df, keyed.where("false"), []).count() == 0


def test_totals_of_the_crosstab_are_not_null_directions(spark):
    rows = spark.createDataFrame([(None, {"secret": 3}), ("inbound", {"secret": 2, "private_email": 1})], "direction string, by_label map<string,bigint>")
    got = {(r.direction, r.label): r.n for r in B.crosstab(rows).collect()}
    assert got[("*", "*")] == 6 and got[(None, "*")] == 3 and got[(None, "secret")] == 3 and got[("*", "secret")] == 5 and len(got) == 8


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_running_totals_match_a_plain_sum(spark, kind):
    rng = random.Random(9)
    t0 = datetime(1969, 12, 30)
    rows = [(t0 + timedelta(microseconds=rng.choice([rng.randrange(5 * 10**11), rng.randrange(3) * 10**6 + rng.randrange(4)])), rng.randint(-3, 3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "at timestamp, v int").withColumn("at", F.col("at").cast(kind))
    got = {r.instant: r.v for r in running_totals(df, "at", {"v": F.col("v")}).collect()}
    assert got == {t: sum(v for u, v in rows if u <= t) for t, _ in rows}
