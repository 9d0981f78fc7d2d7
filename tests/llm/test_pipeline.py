"""The pipeline's stages against plain versions of their decisions, and the driver contract."""

from __future__ import annotations

import re

import corpus_pipeline
from tests.llm.fixtures import SMALL, awkward, frame
from tests.llm.test_operators import check_packing, plain_components, plain_secrets

import __spark_entry__
from maskwright.llm import decontaminate, queries, toxicity


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def redacted(text):
    spans = []
    for part in filter(None, plain_secrets(text)[4].split(",")):
        kind, a, b = part.split(":")
        spans.append((int(a), int(b), kind))
    merged = []
    for a, b, kind in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    for a, b in reversed(merged):
        text = text[:a] + "[]" + text[b:]
    return text


def stages(spark, docs, folder):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs)
    return out


def test_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    a, b, c, d, e = stages(spark, docs, folder)
    assert all(x.columns == docs.columns for x in (a, b, c, d))
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = queries.toxicity_model(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    assert {r.doc_id for r in a.collect()} == clean
    kept = sorted((i, rows[i]) for i in clean)
    first = {i for i, _, least in plain_components(kept) if i == least}
    assert {r.doc_id for r in b.collect()} == first < clean
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.find(b, bench).where("contaminated").collect()}
    assert {r.doc_id for r in c.collect()} == first - bad and bad
    final = {r.doc_id: r for r in d.collect()}
    assert set(final) == first - bad
    for i, r in final.items():
        assert re.sub(r"\[(ASSIGN|ACCESS|HEX|PRIVATE_KEY)\]", "[]", r.text) == redacted(rows[i]) and r.n_chars == len(r.text)
    import public_tokenizers

    check_packing(e.collect(), [(i, r.text) for i, r in final.items()], public_tokenizers.path("word_bpe_49k.json"))


def test_stages_on_awkward_rows(spark):
    docs = frame(spark, [*awkward(), (80, "token = abcdefghijklmnopqrstuvwxyz")]).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS bigint) AS n_chars", "score")
    a, b, c, d, e = stages(spark, docs, SMALL)
    assert a.count() == docs.count()
    texts = [(r.doc_id, r.text) for r in b.collect()]
    assert len(texts) == len({least if least is not None else f for _, f, least in plain_components(awkward() + [(80, "token = abcdefghijklmnopqrstuvwxyz")])})
    assert {r.text for r in d.where("doc_id = 80").collect()} == {"[ASSIGN]"}
    assert e.count() > 0
    empty = stages(spark, docs.where("false"), SMALL)
    assert [x.count() for x in empty] == [0] * 5
