"""Python is called for a bucket of tokens, not for a token, and decides each token as before."""

from datetime import datetime, timedelta

import pandas as pd

from maskwright.streaming import expiring, receipts

T0 = datetime(2024, 5, 1)
ATTEMPT = "event_id bigint, occurred_at timestamp, action string, token string, fingerprint string, confirmed boolean"


def test_tokens_of_a_bucket_are_decided_in_one_call(spark, tmp_path):
    rows = [(k, T0 + timedelta(seconds=k), "prepared", f"t{k}", "1", None) for k in range(9)]
    spark.createDataFrame(rows, ATTEMPT).write.parquet(str(tmp_path / "a"))
    stream = spark.readStream.schema(ATTEMPT).parquet(str(tmp_path / "a"))
    for keyed in (receipts.receipt_changes(stream), expiring.closed_receipts(stream)):
        plan = keyed._jdf.queryExecution().analyzed().toString()
        node = next(line for line in plan.split("\n") if "StateInP" in line or "TransformWithState" in line)
        assert "(bucket#" in node


def test_a_bucket_keeps_its_receipts_apart():
    class Map(dict):
        def exists(self):
            return bool(self)

        def getValue(self, key):  # noqa: N802
            return self.get(key)

        def updateValue(self, key, value):  # noqa: N802
            self[key] = value

    bucket = receipts._Receipts(600_000_000)
    bucket.states = Map()

    def batch(*rows):
        frame = pd.DataFrame(rows, columns=["token", "at", "event_id", "event", "action", "fingerprint"])
        return [tuple(None if pd.isna(v) else v for v in r) for f in bucket.handleInputRows((1,), iter([frame]), None) for r in f.itertuples(index=False)]

    first = batch(("a", 5, 2, "2", "prepared", "f"), ("b", 4, 1, "1", "exported", "f"), ("a", 3, 0, "0", "exported", "f"))
    assert first == [("a", 1, 5, "2", "f", None, None, None)] and set(bucket.states) == {("a",)}
    second = batch(("b", 6, 3, "3", "prepared", "g"), ("a", 7, 4, "4", "exported", "x"), ("a", 8, 5, "5", "exported", "f"))
    assert sorted(second) == [("a", 2, 5, "2", "f", 8, "5", "exported"), ("b", 1, 6, "3", "g", None, None, None)]
    assert batch(("a", 9, 6, "6", "discarded", None)) == []
