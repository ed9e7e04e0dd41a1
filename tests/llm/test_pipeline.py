"""The pipeline's stages, each against a plain version of its decision."""

import re

import pytest

import corpus_pipeline
from oppweave.llm import decontamination, quality, secrets

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "BPE encoding and decoding",
    ]
    assert corpus_pipeline.ORACLE_SQL is None


def test_whole_run_equals_plain_stages(spark, docs):
    rows = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    field = quality.fit_lines(docs, labels)
    kept = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        if not failed and quality._lines(r["text"], field)[1] >= quality.MIN_CONTENT:
            kept.append(r)
    sets = [frozenset(zip(*[re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]).split()[k:] for k in range(5)])) for r in kept]
    group = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    kept = [r for k, r in enumerate(kept) if group.index(group[k]) == k]
    items = [r["text"].lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaked(text):
        words = [w.encode() for w in text.lower().split()]
        return any(
            set(item) & set(text.lower().split()) and decontamination.align(words, [w.encode() for w in item])[0] >= 0.5
            for item in items
        )

    kept = [r for r in kept if not leaked(r["text"])]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == [r["doc_id"] for r in kept]
    for r in kept:
        out = got[r["doc_id"]]
        assert out["round_trip"] and out["n_chars"] == len(out["text"]) and len(out["token_ids"]) == 4 * out["n_tokens"]
        assert (out["text"] == r["text"]) == (not secrets.find(r["text"]))


def test_stages_keep_the_columns_and_stand_empty_tables_nulls_and_clashes(spark, docs):
    odd = spark.createDataFrame(
        [(None, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (1, "", "en", "s", 0, "x")],
        "doc_id long, text string, lang string, source string, n_chars long, kept string",
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == COLUMNS
        assert stage(spark, docs.limit(0), SF).count() == 0
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns
        assert out.count() == (0 if name == "quality rules" else 3)
    last = corpus_pipeline.token_ids(spark, odd.withColumnRenamed("kept", "n_tokens"), SF)
    assert {r["n_tokens"] for r in last.collect()} == {0}
