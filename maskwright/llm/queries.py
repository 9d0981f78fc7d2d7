"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import (
    blob_ledger,
    conversation_repair,
    decontaminate,
    language,
    packing,
    quality_rules,
    repeats,
    simhash,
    token_alignment,
    toxicity,
    warc,
    weak_labels,
    wrapper_induction,
)
from maskwright.llm.reference_sql import ORACLE as ORACLE
from maskwright.llm.storage import stored
from maskwright.sources.scratch import scratch_folder

HELD_OUT_LANGUAGE = "crc32(cast(doc_id AS string)) % 4 = 2"
HELD_OUT_TOXIC = "crc32(cast(doc_id AS string)) % 3 = 1"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, F.expr(f"NOT ({HELD_OUT_LANGUAGE})"))
    found = language.identify(docs, model)
    return found.select("doc_id", F.expr(f"coalesce({HELD_OUT_LANGUAGE}, false) AS held_out"), "lang_pred", "score", "languages")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels, F.expr(f"NOT ({HELD_OUT_TOXIC})"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = toxicity.score(docs, toxicity_model(docs, _table(spark, folder, "labels")))
    return found.select("doc_id", F.expr(f"coalesce({HELD_OUT_TOXIC}, false) AS held_out"), "score", "predicted")


def op4_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    parts = stored(packing.pieces(_table(spark, folder, "documents"), path, with_ids=False), "pieces")
    return packing.pack(parts)


def op6_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    ledger = stored(blob_ledger.scan(docs), "ledger")
    found = blob_ledger.findings_by_path(docs, ledger)
    base = ", ".join(f"'{k}'" for k in blob_ledger.BASE)
    line = "array_join(transform({}, f -> concat(f.label, ':', f.start, ':', f.end)), ',')"
    counts = [F.expr(f"cast(size(filter(findings, f -> f.label = '{k}')) AS bigint) AS n_{k}") for k in blob_ledger.BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.expr(line.format(f"filter(findings, f -> f.label IN ({base}))")), 256).alias("base_sha256"),
        F.expr(line.format("findings")).alias("spans"),
    )


def op7_quality_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules.ledger(_table(spark, folder, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes("v1")).alias("base_failed"),
        quality_rules.passes("v2").alias("kept"),
        "failed",
    )


def quality_rule_ablations(spark: SparkSession, folder: str) -> DataFrame:
    """What each rule of each policy version costs, over the ledger of all documents."""
    return quality_rules.ablations(quality_rules.ledger(_table(spark, folder, "documents")))


def op8_weak_label_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return weak_labels.score(docs, weak_labels.fit(docs))


def op9_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    planned = warc.plan(_table(spark, folder, "pages"))
    manifest = warc.write(planned, scratch_folder(spark, "warc"))
    records = warc.read(spark, manifest, payloads=False)
    return records.select(
        F.col("record_id").cast("long").alias("page_id"),
        "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op10_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, folder, "documents"), with_text=False).drop("kept")


def op11_wrapper_induction(spark: SparkSession, folder: str) -> DataFrame:
    return wrapper_induction.extract(_table(spark, folder, "pages"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations")
    return conversation_repair.with_all(conversation_repair.repair(conversation_repair.damage(rows)), rows)


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return token_alignment.align(
        docs, byte_path=public_tokenizers.path("byte_bpe_50k.json"), piece_path=public_tokenizers.path("piece_bpe_32k.model")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_mixture, op2_decontamination, op3_toxicity, op4_simhash_near_duplicates, op5_packing,
        op6_secret_ledger, op7_quality_rule_ledger, op8_weak_label_quality, op9_warc_round_trip, op10_repeated_passages,
        quality_rule_ablations, op11_wrapper_induction, op12_conversation_repair, op13_token_alignment,
    )
}
