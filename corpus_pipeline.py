"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Every stage but the last returns documents with the columns it was given. NULL texts are treated as
empty, repeated rows are judged like any other row, an empty table passes through empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge import session
from tidegauge.llm import pieces, quality_model, secret_scan, simhash, templates
from tidegauge.llm.tables import read

PREFIX = "_stage_"  # of columns that a stage adds for itself and drops again


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier does not reject."""
    session.prepare(spark)
    model = quality_model.train(docs, read(spark, sf_dir, "labels"))
    names = docs.columns
    scored = quality_model.scores(docs, model, prefix=PREFIX)
    return scored.filter(F.col(f"{PREFIX}predicted") == 1).select(*names)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: the smallest id, then the smallest content.

    Near-duplicates are linked by SimHash: four-word shingles, at most four differing bits.
    Documents without an id come after all others of their group.
    """
    session.prepare(spark)
    marked = docs.withColumn(f"{PREFIX}content", F.xxhash64("text"))
    found = simhash.groups(marked, carry=(f"{PREFIX}content",), root=True)
    best = found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id",
                       F.col(f"{PREFIX}content").alias("content"))).alias("k"))
    kept = best.select(F.col("k.doc_id").alias(f"{PREFIX}id"), F.col("k.content").alias(
        f"{PREFIX}kept"))
    joined = marked.join(kept, F.col("doc_id").eqNullSafe(F.col(f"{PREFIX}id"))
                         & F.col(f"{PREFIX}content").eqNullSafe(F.col(f"{PREFIX}kept")), "left_semi")
    return joined.dropDuplicates(["doc_id", f"{PREFIX}content"]).drop(f"{PREFIX}content")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    session.prepare(spark)
    held = templates.matches(docs, read(spark, sf_dir, "benchmark"))
    folder = session.scratch(spark, "contaminated")
    held.select(F.col("doc_id").alias(f"{PREFIX}id")).distinct().write.parquet(folder)
    held = spark.read.parquet(folder)
    if held.count() <= secret_scan.BROADCAST_ROWS:
        held = F.broadcast(held)
    return docs.join(held, F.col("doc_id").eqNullSafe(F.col(f"{PREFIX}id")), "left_anti")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each secret by the kind of rule that found it; ``n_chars`` follows the text."""
    session.prepare(spark)
    names = docs.columns
    found = secret_scan.with_spans(docs, prefix=PREFIX)
    spans = F.col(f"{PREFIX}spans")
    clean = found.withColumn("text", secret_scan.redacted(F.col("text"), spans))
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(
            F.size(spans) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.select(*names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces, and whether they decode to its text."""
    session.prepare(spark)
    model = pieces.Model.load(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encode(docs, model, digest=True)


STAGES = [
    ("quality_classifier", classify),
    ("simhash_near_dedup", drop_copies),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", redact),
    ("sentencepiece", encode),
]

# The classifier's verdicts are no SQL; the tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of a folder of tables."""
    session.prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = session.scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
