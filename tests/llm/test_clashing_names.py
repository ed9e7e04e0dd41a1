"""Columns named like those that the operators make on the way pass through unchanged."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oppweave.llm import bpe, decontamination, jaccard, quality, secrets, sharding

NAMES = [
    "row", "judged", "coded", "block0", "_block", "_cell", "_place", "_ends", "_row", "_id", "_group", "_order", "_first", "_goes",
    "_copies", "_gone_id", "_gone_row", "_text", "set_key", "component", "id", "hash", "found", "other", "ids", "_before", "_decoded",
    "_coded", "_matches0", "_judged", "_set", "content", "chunk", "part", "shingle", "n", "a.b",
]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, f"{k} one two three four five six seven eight nine ten eleven password: Xk29vTq7ZpLm{k}") for k in range(5)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    return plain.select("*", *[F.concat(F.lit(f"{name}-"), F.col("doc_id")).alias(name) for name in NAMES]).coalesce(1)


def unchanged(df):
    got = df.select("doc_id", *[F.col(f"`{n}`") for n in NAMES]).collect()
    return bool(got) and all(r[n] == f"{n}-{r['doc_id']}" for r in got for n in NAMES)


def test_operators(spark, docs):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    field = quality.fit_field([("good words here and there.", 1), ("bad bad bad", 0)])
    for df in (
        bpe.checked(docs, corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")),
        decontamination.match_items(docs, items), jaccard.drop_near_copies(docs), quality.judge(docs, field), secrets.redact(docs),
        sharding.shuffle_into_shards(docs, 2, ["doc_id", "text"]),
    ):
        assert unchanged(df)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, name, stage):
    got = stage(spark, docs, SF)
    assert set(docs.columns) <= set(got.columns)
    assert got.isEmpty() or unchanged(got)
