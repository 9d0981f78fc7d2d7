"""A training corpus from raw documents, in stages; each takes and returns rows with the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.spans import hold, merge, redact
from maskwright.llm import blob_ledger, decontaminate, packing, queries, simhash, toxicity
from maskwright.llm.storage import stored


# A row goes through a per-row operator as a whole, in the place of its id: decisions need no join,
# and rows that repeat an id, or have none, are decided one by one.
_ROW = "_row"


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*docs.columns).alias(_ROW), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict toxic."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    scored = toxicity.score(_rows(docs), queries.toxicity_model(docs, labels), id_col=_ROW)
    return scored.where("predicted = 0").select(f"{_ROW}.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates one document, that with the smallest id; a null id is the largest."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("mark"))
    found = simhash.near_duplicates(docs.select(key.alias("_key"), "text"), id_col="_key")
    first = found.where("_key = component_id").select(F.col("_key").alias("_first")).distinct()
    kept = docs.withColumn("_key", key).join(first, F.col("_key") == F.col("_first"), "left_semi")
    return kept.dropDuplicates(["_key"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = decontaminate.find(_rows(docs), benchmark, id_col=_ROW)
    return found.where("NOT contaminated").select(f"{_ROW}.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; every secret is replaced by its kind, ``n_chars`` follows the new text."""
    ledger = stored(blob_ledger.scan(docs), "ledger")
    found = blob_ledger.findings_by_path(docs, ledger).where("size(findings) > 0")
    found = found.select("blob", F.expr(merge("findings")).alias("_spans")).dropDuplicates(["blob"])
    marked = docs.withColumn("_blob", F.sha2(F.coalesce("text", F.lit("")), 256))
    marked = marked.join(found.withColumnRenamed("blob", "_blob"), "_blob", "left")
    marked = hold(marked, {"_clean": redact("text", "_spans", lambda s: f"concat('[', upper({s}.label), ']')")})
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.col("_clean"))
    rows = marked.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    parts = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packing.pack(stored(parts, "pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

# Training a classifier and tokenizing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder; each result is written and read back."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
