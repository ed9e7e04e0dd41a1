"""Stages that clean the documents table for training; each stage's result is written and read by the next.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and passes its other columns
through. Null texts fail the quality rules; a table without rows goes through all stages as it is.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oppweave.llm import bpe, decontamination, jaccard, quality, secrets
from oppweave.llm.files import small_batches, stored

VOCABULARY = "byte_bpe_50k.json"
KEPT_PIECES = 60_000  # workers serve all stages, so they keep less than for encoding alone


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the line field reject; the field is fitted on labelled rows of ``docs``."""
    small_batches(spark)
    field = quality.fit_lines(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs.select(F.struct("*").alias("row"), "text"), field).filter("kept").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the smallest id."""
    small_batches(spark)
    return jaccard.drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item stands, copied or edited."""
    small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    matched = decontamination.match_items(docs.select(F.struct("*").alias("row"), "text"), items)
    return matched.filter(F.size("matches") == 0).select("row.*")


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mask and counts the characters of changed texts anew; no document goes."""
    small_batches(spark)
    rows = docs.select(F.struct("*").alias("row"), "text")
    masked = secrets.redact(rows)
    own = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    if "n_chars" in docs.columns:
        changed = ~F.col("text").eqNullSafe(F.col("row.text"))
        count = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        own[docs.columns.index("n_chars")] = F.when(changed, count).otherwise(F.col("row.n_chars")).alias("n_chars")
    return masked.select(*own)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of the whole text, their number, and whether they decode to the text again."""
    small_batches(spark)
    rows = docs.drop("token_ids", "n_tokens", "round_trip")
    coded = bpe.checked(rows, public_tokenizers.path(VOCABULARY), kept=KEPT_PIECES)
    n_tokens = (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens")
    return coded.select(*[F.col(f"`{c}`") for c in rows.columns], "token_ids", n_tokens, "round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scans", masked_secrets),
    ("BPE encoding and decoding", token_ids),
]

#: DuckDB SQL cannot express the stages; they are tested against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
