"""Shapes that keep the work in proportion to the input."""

from pathlib import Path

from pyspark.sql import functions as F

from maskwright.operators import directory, review
from maskwright.plans import scans


def test_a_text_file_does_not_grow_with_its_language(spark, tmp_path, monkeypatch):
    docs = [(i, "a@b.example" if i % 3 else None, "en" if i % 5 else None) for i in range(90)]
    folder = tmp_path / "data"
    spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(folder / "documents.parquet"))
    monkeypatch.setattr(scans, "scratch_folder", lambda _, name: str(tmp_path / name))
    monkeypatch.setattr(scans, "_FILE_DOCUMENTS", 10, raising=False)
    got = {r.lang: (r.chars, r.addresses) for r in scans.a8_scanned_files(spark, str(folder)).collect()}
    files = [p.read_text() for p in Path(tmp_path / "texts").glob("lang=*/*.txt")]
    assert max(t.count("\n") for t in files) <= 10 and sum(t.count("\n") for t in files) == 90
    assert got == {
        lang: (sum(len(t or "") + 1 for _, t, g in docs if (g or "none") == lang), sum(t is not None for _, t, g in docs if (g or "none") == lang))
        for lang in ("en", "none")
    }


def test_people_who_share_a_name_are_searched_for_once(spark, monkeypatch):
    """The rows that reach the search, and what a text shuffles, do not grow with the people behind a name."""
    staff = spark.range(40).selectExpr("id AS staff_ord", "'Greta Holm' AS name", "'p' || id || '@in.example' AS email", "'r' AS role")
    texts = spark.range(30).selectExpr("id AS message_id", "IF(id % 3 = 0, 'ask GRETA holm ', 'nobody ') || id AS _text")
    for small in (True, False):
        keyed = []
        monkeypatch.setattr(directory, "written", lambda df, name: keyed.append(df) or df)
        got = {(r.message_id, r.staff_ord, r.kind, r.start) for r in directory.by_fragment(texts, staff, small).collect()}
        assert got == {(m, p, "name", 4) for m in range(0, 30, 3) for p in range(40)}
        assert keyed and keyed[0].count() == 41  # one name and forty addresses


def test_a_large_directory_is_not_broadcast(spark, monkeypatch):
    """What the route of a large directory joins is never collected on the driver, however small its file looks."""
    staff = spark.range(40).selectExpr("id AS staff_ord", "'Greta Holm' AS name", "'p' || id || '@in.example' AS email", "'r' AS role")
    texts = spark.range(30).selectExpr("id AS message_id", "IF(id % 3 = 0, 'ask GRETA holm ', 'nobody ') || id AS _text")
    keyed = []
    stored = directory.written
    monkeypatch.setattr(directory, "written", lambda df, name: keyed.append(df) or stored(df, name))
    spark.conf.set("spark.sql.maxPlanStringLength", "100000000")
    found = directory.by_fragment(texts, staff, False)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (*keyed, found)]
    assert len(plans) == 2 and not any("Broadcast" in plan for plan in plans)
    assert found.count() == 400


def test_candidates_are_not_moved_to_find_the_first_issue(spark):
    """The whole candidate is shuffled by the join alone; equal rows and ties count as one, a null time comes first."""
    rows = [("a", 5, "x"), ("a", 3, "y"), ("a", 3, "y"), ("b", 4, "z"), ("b", None, "w"), ("c", 1, "v")]
    issued = spark.createDataFrame(rows, "token string, s long, use_case string").selectExpr(
        "token", "timestamp_seconds(s) AS issued_at", "use_case", "'e' AS engine", "'p' AS policy_version",
        "cast(null AS struct<all_recipients_internal:boolean,crosses_boundary:boolean,recipient_count:int>) AS routing",
        "map('text', use_case) AS candidate_fields",
    )
    marked = issued.withColumn("fingerprint", F.expr(review.fingerprint(b"k")))
    done = marked.where("use_case IN ('y', 'w', 'v')").selectExpr("token", "1 AS event_id", "fingerprint", "'exported' AS outcome").distinct()
    released = review.export(issued, done, b"k")
    assert sorted((r.token, r.use_case) for r in released.collect()) == [("a", "y"), ("b", "w"), ("c", "v")]
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        plan = review.export(issued, done, b"k")._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    moved = plan.split("Exchange hashpartitioning(token")
    assert all("partial_min_by" not in below.split("Exchange")[0] for below in moved[1:])
