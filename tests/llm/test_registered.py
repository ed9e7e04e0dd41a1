"""Registered queries that no other test runs, against the library and a full comparison."""

import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from oppweave.llm import decontamination, queries

SF = "/root/testdata/sf0.001"


def test_bpe_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op3_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_decontamination_query(spark):
    items = {r[0]: [w.encode() for w in r[1].lower().split()] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = set()
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        words = [w.encode() for w in (text or "").lower().split()]
        for item_id, item in items.items():
            if len(set(item) & set(words)) >= len(set(item)) // 4 and decontamination.align(words, item, 0.5)[0] >= 0.5:
                want.add((doc_id, item_id))
    got = {(r["doc_id"], r["item_id"]) for r in queries.op10_decontamination(spark, SF).collect()}
    assert got and got == want
