"""Corpus pipeline: quality rules, n-gram Jaccard join, decontamination, secret scans, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and reread as the next one's docs.
All but the last keep the columns of ``documents``; other columns are left out.
Verdicts belong to rows, by id and text: a null id is an id like others, and rows
that repeat an id don't share theirs. Every stage gives no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from targetlake.llm import decontamination, jaccard, packing, quality_rules, secret_scans
from targetlake.llm.scratch import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep, each row by its own verdict.

    A null text has no words and goes; a null language or source is a group; repeated rows stay or go together.
    """
    parts = [x for c in ("text", "lang", "source") for x in (c, F.isnull(c))]
    rows = docs.select(*COLUMNS, F.xxhash64(*parts).alias("_row"))
    kept = quality_rules.judged(rows, keys=("_row",)).where("kept").select(F.col("doc_id").alias("_id"), F.col("_row").alias("_kept")).distinct()
    return rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_kept")), "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id.

    Null ids take part in nothing and stay. Repeated rows and equal texts are one; different
    texts with one id are two, and texts without words are linked with their equals alone.
    """
    docs = docs.select(*COLUMNS)
    return jaccard.deduplicated(docs.where("doc_id IS NOT NULL")).unionByName(docs.where("doc_id IS NULL"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of a benchmark window; null texts have none and stay, as do null and repeated ids whose own text is clean."""
    return decontamination.decontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def secret_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; ``n_chars`` follows the new text and is null for a null one. All rows stay."""
    docs = docs.select(*COLUMNS)
    clean = secret_scans.redacted(docs, secret_scans.by_blob(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences; a null text is empty and has the end id alone, repeated rows are packed one by one."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_free),
    ("secret_scans", secret_free),
    ("best_fit_packing", packed),
]

#: The packing stage runs a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
