import json
import random
import re
from email.errors import MessageError
from email.headerregistry import Address
from email.utils import getaddresses

import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskwright import fixed_values as V
from maskwright.operators import detect as D
from maskwright.operators import prepare as P
from maskwright.operators import routing as R

SCHEMA = f"request_id string, use_case string, fields map<string,string>, manual_masks {P.MASKS}"
INSIDE = ["in.example"]


def run(spark, requests, **options):
    rows = [(str(i), *r) if len(r) == 3 else (str(i), *r, None) for i, r in enumerate(requests)]
    done = P.prepare(spark.createDataFrame(rows, SCHEMA), internal_domains=INSIDE, **options)
    got = {int(r.request_id): r for r in done.collect()}
    return [got[i] for i in range(len(requests))]


def mail(**changes):
    base = {"sender": "Ann <ann@in.example>", "recipients": "bo@out.example", "subject": "", "body": "hi"}
    return ("email", {**base, **changes})


def text(value, masks=None):
    return ("support_ticket", {"text": value}, masks)


def test_masks_placeholders_and_sources(spark):
    a = "😀 Åsa met carla@mail.example"
    rows = run(
        spark,
        [
            text("carla@mail.example dan@mail.example carla@mail.example"),
            text("[PRIVATE_EMAIL_1] [PRIVATE_EMAIL_3] carla@mail.example dan@mail.example"),
            text(a, [("text", 2, 5)]),
            text(a, [("text", 6, 15)]),
            text('passwd="blue river stone"; secret=k9x; Token: q7'),
            mail(subject="For carla@mail.example", body="dan@mail.example, carla@mail.example [PRIVATE_EMAIL_1]", recipients="B <b@IN.example>, c@out.example"),
        ],
    )
    out = [r.candidate_fields for r in rows]
    assert out[0]["text"] == "[PRIVATE_EMAIL_1] [PRIVATE_EMAIL_2] [PRIVATE_EMAIL_1]"
    assert out[1]["text"] == "[PRIVATE_EMAIL_1] [PRIVATE_EMAIL_3] [PRIVATE_EMAIL_2] [PRIVATE_EMAIL_4]"
    assert out[2]["text"] == "😀 [MANUAL_1] met [PRIVATE_EMAIL_1]"
    assert rows[2].manual_mask_count == 1 and rows[2].findings[0].sources == ["manual"]
    assert (rows[3].findings[0].start, rows[3].findings[0].end) == (6, len(a))
    assert rows[3].findings[0].sources == ["detector", "manual"]
    assert out[4]["text"] == "[SECRET_1]; [SECRET_2]; [SECRET_3]"
    assert out[5] == {
        "sender": "[SENDER_REMOVED]", "recipients": "[RECIPIENTS_REMOVED]", "subject": "For [PRIVATE_EMAIL_2]",
        "body": "[PRIVATE_EMAIL_3], [PRIVATE_EMAIL_2] [PRIVATE_EMAIL_1]",
    }
    assert rows[5].routing.asDict() == {"recipient_count": 2, "crosses_boundary": True, "all_recipients_internal": False}
    assert [f.field for f in rows[5].findings] == ["sender", "recipients", "subject", "body", "body"]
    assert rows[5].by_label == {"private_email": 5} and rows[5].span_count == 5
    assert all("text" not in f.asDict() and "match" not in f.asDict() for r in rows for f in r.findings)


def test_requests_outside_the_contract_are_set_aside(spark):
    cases = {
        "unknown_use_case": [("memo", {"text": "a"})],
        "wrong_fields": [("ai_prompt", {"body": "a"}), ("ai_prompt", {"text": "a", "body": "b"}), ("email", {"text": "a"})],
        "input_empty": [text(""), text("  \n\x1f ")],
        "invalid_mask": [text("abc", [m]) for m in [("body", 0, 1), ("text", 2, 1), ("text", -1, 1), ("text", 0, 4), ("text", 1, 1)]],
        "invalid_email_routing": [
            mail(recipients=r) for r in ["", " ", "broken", "a@b.c\r\nBcc: d@e.f", "a@b.c\x00", "a@b.c,", "a@"]
        ] + [mail(sender="a@b.c, d@e.f"), mail(sender="nobody")],
    }
    flat = [(reason, request) for reason, requests in cases.items() for request in requests]
    rows = run(spark, [request for _, request in flat])
    for (reason, request), row in zip(flat, rows):
        assert row.reject_reason == reason, request
        assert row.candidate_fields is None and row.findings is None and row.span_count is None


def test_limits_only_flag(spark):
    over = [
        ("text_chars", text("y" * 16_001)),
        ("manual_masks", text("abc", [("text", 0, 1)] * 129)),
        ("recipients", mail(recipients=", ".join(["a@b.co"] * 21))),
        ("findings_per_field", text(" ".join(f"a{i}@b.co" for i in range(513)))),
        ("body_bytes", text("🌲" * 5900)),
    ]
    within = [text("y" * 16_000), text("abc", [("text", 0, 1)] * 128), mail(recipients=", ".join(["a@b.co"] * 20))]
    rows = run(spark, [r for _, r in over] + within, limits=V.REQUEST_LIMITS)
    assert [r.reject_reason for r in rows] == [None] * len(rows)
    assert [r.limit_flags for r in rows] == [[name] for name, _ in over] + [[]] * len(within)
    assert rows[0].candidate_fields["text"] == "y" * 16_001 and rows[1].manual_mask_count == 129
    assert rows[2].routing.recipient_count == 21
    assert rows[3].span_count == 513 and rows[3].candidate_fields["text"].endswith("[PRIVATE_EMAIL_513]")


def test_size_of_an_export_body_is_exact(spark):
    texts = ['plain "quoted" back\\slash', "tab\t nl\n cr\r bs\b ff\f nul\x00 del\x7f esc\x1b", "é ﷐ 😀  ", ""]
    cases = [("ai_prompt", {"text": t}, None) for t in texts]
    cases += [("email", {"sender": "a", "recipients": "b", "subject": t, "body": t}, (1, True, False)) for t in texts]
    df = spark.createDataFrame(
        cases, "use_case string, candidate_fields map<string,string>, "
        "routing struct<recipient_count:int,crosses_boundary:boolean,all_recipients_internal:boolean>"
    )
    for r in df.withColumn("n", F.expr(P.candidate_bytes("heuristic"))).collect():
        routing = r.routing and {
            "recipient_count": r.routing[0], "crosses_example_boundary": r.routing[1], "all_recipients_internal": r.routing[2]
        }
        body = {
            "receipt": "x" * 43, "confirmed": True,
            "candidate": {"use_case": r.use_case, "policy_version": V.POLICY_VERSION, "engine": "heuristic",
                          "fields": r.candidate_fields, "routing": routing},
        }
        assert r.n == len(json.dumps(body))


def test_address_notations(spark):
    rows = {
        "a@b.co": ["b.co"], "Ann B. Cole <a@B.Co>": ["b.co"], '"Cole, Ann" <a@b.co>, d@e.f': ["b.co", "e.f"], " a@b.co ": ["b.co"],
        "a@b.co (home)": ["b.co"], '"odd name"@b.co': ["b.co"], "Åsa <a@b.co>": ["b.co"],
        "<a@b.co": ["b.co"], "o'neil@b.co": ["b.co"], "x@bücher.example": ["bücher.example"], '"(a) b, \\"c\\"" <a@b.co>': ["b.co"],
        "grp: a@b.co;": None, "a@[10.0.0.1]": None, "a (b (c)) <a@b.co>": None,
        "a b@c.d": None, "a@@b": None, "a@b.co; d@e.f": None,
    }
    df = spark.createDataFrame([(k,) for k in rows], "h string")
    got = {r.h: r.d for r in R.with_domains(df, F.col("h"), "d").collect()}
    assert got == rows


def test_read_addresses_are_those_of_the_standard_library(spark):
    def plain(value):
        try:
            boxes = [Address(addr_spec=spec) for _, spec in getaddresses([value], strict=True)]
        except (ValueError, IndexError, MessageError):
            return None
        return [b.domain.lower() for b in boxes] if boxes and all(b.username and b.domain for b in boxes) else None

    rng = random.Random(3)
    bits = ["a@b.co", "c.d@e.F", "<a@b.co>", "<", ">", ",", ", ", " ", "Ann", "B.", '"', '"x, y" ', "(z)", "@", ".", "é", "'", "\\"]
    texts = sorted({"".join(rng.choice(bits) for _ in range(rng.randint(1, 6))) for _ in range(12_000)})
    df = spark.createDataFrame([(t,) for t in texts], "h string")
    got = {r.h: r.d for r in R.with_domains(df, F.col("h"), "d").collect() if r.d is not None}
    assert len(got) > 100
    assert {h: (plain(h), d) for h, d in got.items() if plain(h) != d} == {}


def test_very_long_recipient_lists(spark):
    df = spark.createDataFrame([(n, ", ".join(f'"P, {i}" <p{i}@d{i}.example>' for i in range(n))) for n in (1, 30_000)], "n int, h string")
    assert {(r.n, len(r.d)) for r in R.with_domains(df, F.col("h"), "d").collect()} == {(1, 1), (30_000, 30_000)}


def test_no_python_in_the_plan(spark, capsys):
    df = spark.createDataFrame([("1", "ai_prompt", {"text": "T"}, None)], f"request_id string, use_case string, fields map<string,string>, manual_masks {P.MASKS}")
    P.prepare(df).explain()
    shown = capsys.readouterr().out
    assert "Scan" in shown and "EvalPython" not in shown


def test_matching_masks_overlap(spark):
    cases = [("ananana", "ana", [(0, 3), (2, 5), (4, 7)]), (r"x\E.\E.", r"\E.", [(1, 4), (4, 7)]), ("﷐a﷐a", "a", [(1, 2), (3, 4)]), ("😀b😀b", "😀b", [(0, 2), (2, 4)]), ("ab", "abc", []), ("", "a", []), ("ab", "", []), ("A", "a", [])]
    df = spark.createDataFrame([(t, n) for t, n, _ in cases], "t string, n string")
    got = [[(m.start, m.end) for m in r.m] for r in df.select(F.expr(P.matching_masks("t", "n")).alias("m")).collect()]
    assert got == [e for _, _, e in cases]


def test_matching_masks_of_any_content(spark):
    """A million code points with reserved characters, many places, a long tail without any."""
    reserved = "".join(chr(0xFDD0 + k) for k in range(32)) + "\ufffe"
    unit = reserved + "anana\n😀"
    for text, needle in [(unit * 25_000, "ana"), (unit + "b" * 1_000_000, "ana"), ("a" * 100_000, "aa")]:
        df = spark.createDataFrame([(text, needle)], "t string, n string")
        got = [(m.start, m.end) for m in df.select(F.expr(P.matching_masks("t", "n")).alias("m")).first().m]
        starts = [k.start() for k in re.finditer(f"(?={needle})", text)]
        assert got == [(k, k + len(needle)) for k in starts]


def test_policy_holds_without_detector_help_and_bad_models_stop(spark):
    def silent(batches):
        for texts in batches:
            yield pd.Series([[] for _ in texts])

    def broken(batches):
        for texts in batches:
            yield pd.Series([[("private_email", 0, 10**6)] for _ in texts])

    D.register_model("silent", silent)
    D.register_model("broken", broken)
    (row,) = run(spark, [text('mail carla@mail.example; password="two words"')], engine="silent")
    assert row.candidate_fields["text"] == "mail carla@mail.example; [SECRET_1]"
    assert row.findings[0].sources == ["credential_rule"] and row.engine == "silent"
    with pytest.raises(Exception, match="invalid span"):
        run(spark, [text("some text")], engine="broken")


def test_uncovered_ranges_are_measured_by_overlap(spark):
    expected = spark.createDataFrame([(1, 0, 10), (1, 20, 25), (2, 0, 5)], "id int, start int, end int")
    covered = spark.createDataFrame([(1, 0, 4), (1, 4, 10), (1, 21, 30)], "id int, start int, end int")
    gaps = P.uncovered_expected(expected, covered, ["id"]).orderBy("id").collect()
    assert [(g.id, g.start, g.missing) for g in gaps] == [(1, 20, 1), (2, 0, 5)]


def test_many_findings_in_one_text(spark):
    """Numbers, sources and masked text where there are more findings than a run, some repeated, some names taken."""
    names = [f"p{k % 150}@mail.example" for k in range(400)]
    text = "[PRIVATE_EMAIL_3] é😀 " + " and\n".join(names) + " token = abcdefgh end"
    hand = [("text", 0, 4), ("text", len(text) - 3, len(text))]
    df = spark.createDataFrame([("r", "ai_prompt", {"text": text}, hand)], f"request_id string, use_case string, fields map<string,string>, manual_masks {P.MASKS}")
    (row,) = P.prepare(df).collect()
    number, out, at = {}, "", 0
    for f in row.findings:
        match = text[f.start : f.end]
        known = number.setdefault(f.label, {})
        if match not in known:
            n = max([0, *known.values()]) + 1
            while f"[{f.label.upper()}_{n}]" in text:
                n += 1
            known[match] = n
        assert f.placeholder == f"[{f.label.upper()}_{known[match]}]"
        out += text[at : f.start] + f.placeholder
        at = f.end
    assert row.candidate_fields["text"] == out + text[at:] and len(number["private_email"]) == 150 and len(row.findings) == 403
    by = {(f.start, f.end): f.sources for f in row.findings}
    assert by[hand[0][1:]] == ["manual"] and by[hand[1][1:]] == ["manual"]
    assert [s for f, s in by.items() if "token" in text[slice(*f)]] == [["credential_rule", "detector"]]
