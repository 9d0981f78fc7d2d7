"""Closed-schema loaders: what is refused, and why."""

import json

from maskwright.operators import prepare as P
from maskwright.sources import requests as Q

RECEIPT = "Az09_-" * 6


def load(spark, tmp_path, read, lines):
    path = tmp_path / "in"
    path.mkdir()
    (path / "lines.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n", encoding="utf-8")
    return read(spark, str(path))


def test_prepare_requests(spark, tmp_path):
    good = {"request_id": "r", "use_case": "ai_prompt", "fields": {"text": "call 😀 \"x\""}}
    mask = lambda **m: {**good, "manual_masks": [{"field": "text", "start": 0, "end": 1, **m}]}
    cases = [
        (good, None), (mask(), None), ({**good, "manual_masks": []}, None), (mask(start=-1), None), (mask(end=999), None),
        ("{broken", "not_json"), ('{"use_case": "email", "use_case": "email"}', "not_json"), ("[1]", "wrong_type: request"), ("null", "wrong_type: request"),
        ({**good, "extra": 1}, "unknown_field: request"), ({"request_id": "r", "use_case": "email"}, "missing_field: request"),
        ({**good, "request_id": 7}, "wrong_type: request_id"), ({**good, "use_case": None}, "wrong_type: use_case"),
        ({**good, "use_case": "memo"}, "unknown_value: use_case"), ({**good, "fields": "text"}, "wrong_type: fields"),
        ({**good, "fields": {"text": 5}}, "wrong_type: fields"), ({**good, "fields": {"text": None}}, "wrong_type: fields"),
        ({**good, "manual_masks": None}, "wrong_type: manual_masks"), ({**good, "manual_masks": {}}, "wrong_type: manual_masks"),
        (mask(start=True), "wrong_type: manual_masks"), (mask(start="0"), "wrong_type: manual_masks"), (mask(start=0.0), "wrong_type: manual_masks"),
        (mask(end=1.5), "wrong_type: manual_masks"), (mask(more=1), "wrong_type: manual_masks"), (mask(end=2**40), "wrong_type: manual_masks"),
        ({**good, "manual_masks": [{"field": "text", "start": 0}]}, "wrong_type: manual_masks"), ({**good, "manual_masks": [3]}, "wrong_type: manual_masks"),
    ]
    rows = load(spark, tmp_path, Q.read_prepare_requests, [c for c, _ in cases])
    got = rows.collect()
    assert [(r.line, r.refused) for r in got] == [(c if isinstance(c, str) else json.dumps(c), why) for c, why in cases]
    assert all(r.request_id is None and r.fields is None for r in got if r.refused) and Q.refused(rows).count() == 22
    assert got[0].fields == {"text": 'call 😀 "x"'} and got[0].manual_masks == [] and got[1].manual_masks[0].end == 1
    # what is sound is judged by prepare
    verdicts = P.prepare(Q.accepted(rows)).select("reject_reason").collect()
    assert [r[0] for r in verdicts] == [None, None, None, "invalid_mask", "invalid_mask"]


def test_export_requests(spark, tmp_path):
    candidate = {"use_case": "email", "engine": "heuristic", "fields": {"body": "b"}, "routing": {"recipient_count": 2, "crosses_example_boundary": True, "all_recipients_internal": False}}
    good = {"receipt": RECEIPT, "candidate": candidate, "confirmed": True}
    part = lambda **c: {**good, "candidate": {**candidate, **c}}
    route = lambda **c: part(routing={**candidate["routing"], **c})
    cases = [
        (good, None), (part(routing=None), None),
        *[({**good, "confirmed": c}, why) for c, why in ((False, "review_required"), ("true", "wrong_type: confirmed"), (1, "wrong_type: confirmed"), (None, "wrong_type: confirmed"))],
        ({"receipt": RECEIPT, "candidate": candidate}, "missing_field: request"), ({**good, "receipt": "short"}, "unknown_value: receipt"),
        ({**good, "receipt": RECEIPT + "\n"}, "unknown_value: receipt"), (part(extra=1), "unknown_field: candidate"), (part(fields={"body": 1}), "wrong_type: fields"),
        (part(policy_version="other"), "unknown_value: policy_version"), (route(recipient_count=True), "wrong_type: routing"), (route(recipient_count=2.0), "wrong_type: routing"),
        (route(all_recipients_internal="no"), "wrong_type: routing"), (route(more=1), "unknown_field: routing"), (part(routing=[]), "wrong_type: routing"),
    ]
    got = load(spark, tmp_path, Q.read_export_requests, [c for c, _ in cases]).collect()
    assert [r.refused for r in got] == [why for _, why in cases]
    assert got[0].routing.recipient_count == 2 and got[0].routing.crosses_example_boundary is True and got[1].routing is None
    assert got[0].receipt == RECEIPT and all(r.receipt is None for r in got if r.refused)
