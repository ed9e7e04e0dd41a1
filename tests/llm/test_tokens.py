"""BPE, prefix counts and token files against the tokenizers library."""

import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from oppweave.llm import bpe, queries, token_counts, token_files, vocabulary
from oppweave.llm.files import Ranges, shared_folder
from oppweave.llm.vocabulary import Vocabulary

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, token_ids string, n_tokens string"
TEXTS = [
    "The house, the mouse.", "", None, " ", "  two  spaces ", "a \n b\n\nc", "it's DON'T we'll 1234 x²", "É été Ünïcode ﬁ",
    "<|endoftext|> a<|endoftext|>b", "<|startoftext|>x", "日本語 テキスト 🙂🙂", "tab\tand\x1cctrl\x00", "İΣς ΑΣ", "word " * 3000,
    "x" * 5000, "same text", "same text", "### *** $$$ ...", "é ö",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "clash", "clash") for k, t in enumerate(TEXTS)], SCHEMA)


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def ids(path, text):
    return library(path).encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_library_and_decodes(docs):
    coded = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
    assert len(coded) == len(TEXTS)
    for row in coded:
        want = ids(BYTE, row["text"])
        assert list(struct.unpack(f"<{len(want)}I", row["token_ids"])) == want
        assert row["decoded"] == library(BYTE).decode(want, skip_special_tokens=False)


def test_round_trip_is_encode_and_decode(docs):
    both = {r["doc_id"]: (r["token_ids"], r["decoded"], r["n_tokens"]) for r in bpe.round_trip(docs, BYTE).collect()}
    apart = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
    assert both == {r["doc_id"]: (r["token_ids"], r["decoded"], r["n_tokens"]) for r in apart}


def test_a_full_memo_gives_the_same_values():
    from oppweave.llm.vocabulary import Memo

    memo = Memo(lambda k: k * 2, 6)
    assert [memo[k % 17] for k in range(400)] == [2 * (k % 17) for k in range(400)]
    assert len(memo) + len(memo.old) <= 6


def test_bpe_of_no_rows_and_bad_bytes(spark, docs):
    assert bpe.decode(bpe.encode(docs.limit(0), BYTE), BYTE).count() == 0
    broken = spark.createDataFrame([(bytearray(struct.pack("<I", 127)),), (None,)], "token_ids binary")
    assert {r["decoded"] for r in bpe.decode(broken, BYTE).collect()} == {
        library(BYTE).decode([127], skip_special_tokens=False), ""
    }


def test_a_vocabulary_with_word_ends_cannot_be_decoded():
    with pytest.raises(ValueError):
        bpe.Encoder(Vocabulary(open(WORD).read()))


def test_counts_equal_library(docs):
    for path in (WORD, BYTE):
        for row in token_counts.count_tokens(docs, path).collect():
            assert row["n_tokens"] == len(ids(path, row["text"])), row["text"]


def test_every_prefix_count_is_the_library_count():
    for path in (WORD, BYTE):
        counter = token_counts.PrefixCounter(Vocabulary(open(path).read()))
        for text in ("thereinaftershblewhing", "un deux.trois, quatre"):
            words = text if path == WORD else text.split(" ")[0]
            if " " in words:
                assert counter.prefixes(words)[-1] == len(ids(path, words))
                continue
            assert counter.prefixes(words) == [len(ids(path, words[: k + 1])) for k in range(len(words))]


def test_budget_questions_from_stored_counts(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, ""), (3, None)], "doc_id long, text string")
    rows = token_counts.prefix_counts(docs, WORD)
    got = {r[0]: r[1] for r in rows.select("doc_id", token_counts.cut_at(rows["prefix_tokens"], 2)).collect()}
    assert got == {1: len("onetwo"), 2: 0, 3: 0}
    counter = token_counts.PrefixCounter(Vocabulary(open(WORD).read()))
    assert counter.fit("one two three four", 2) == (2, 2) and counter.fit("one", 0) == (0, 0)


def test_token_files_hold_all_documents_in_order(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    files = token_files.write_token_files(docs, BYTE, 2, token_files.token_file_folder(spark))
    got = token_files.read_token_files(spark, files).collect()
    assert sorted(str(r["key"]) for r in got) == sorted(str(k) for k, _ in rows)
    got.sort(key=lambda r: r["start"])
    keys = [-1 if r["key"] is None else r["key"] for r in got]
    assert keys == sorted(keys)
    start, texts = 0, dict(rows)
    for r in got:
        assert r["start"] == start
        start += len(r["ids"]) // 4
        if r["key"] not in (3, None):
            want = ids(BYTE, texts[r["key"]]) + [2]
            assert bytes(r["ids"]) == struct.pack(f"<{len(want)}I", *want)


def test_token_files_of_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    files = token_files.write_token_files(docs, BYTE, 2, token_files.token_file_folder(spark))
    assert token_files.read_token_files(spark, files).count() == 0


def test_reader_opens_only_the_frames_it_needs_and_checks_them(spark, tmp_path):
    import zstandard

    name = shared_folder(spark, "one") + "/x.zst"
    out = token_files.Writer(token_files.create(name), 2)
    rng = np.random.default_rng(0)
    arrays = [rng.integers(0, 50_000, n) for n in rng.integers(0, 400_000, 12)]
    for k, a in enumerate(arrays):
        out.add(k, a)
    out.close()
    with Ranges(name) as ranges:
        reader = token_files.Reader(ranges)
        for k in (11, 0, 5):
            assert (reader.ids(k) == arrays[k]).all()
        whole = ranges(0, ranges.size)
    # Any zstandard reader sees the frames; the seek table is skippable.
    raw = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(whole)
    assert raw.startswith(np.concatenate(arrays).astype("<u2").tobytes())
    damaged = bytearray(whole)
    damaged[1000] ^= 1
    with open(tmp_path / "bad.zst", "wb") as f:
        f.write(damaged)
    with Ranges(f"file://{tmp_path}/bad.zst") as ranges, pytest.raises(Exception):
        token_files.Reader(ranges).ids(0)


def test_queries_match_the_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    byte = library(BYTE)
    start = 0
    got = {r["doc_id"]: r for r in queries.op9_token_files(spark, sf).collect()}
    for k in sorted(texts):
        want = byte.encode(texts[k], add_special_tokens=False).ids + [2]
        assert (got[k]["start"], got[k]["n_tokens"]) == (start, len(want))
        assert got[k]["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(want)}I", *want))
        start += len(want)
    word = library(WORD)
    for r in queries.op5_token_counts(spark, sf).collect():
        n = len(word.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 2048)


def test_loading_a_vocabulary_gives_back_what_reading_took(monkeypatch):
    calls = []
    monkeypatch.setattr(vocabulary, "_LOADED", {})
    monkeypatch.setattr(vocabulary, "give_back", lambda: calls.append(1))
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        text = f.read()
    encoder = vocabulary.load(bpe.Encoder, text)
    assert len(calls) == 2 and vocabulary.load(bpe.Encoder, text) is encoder and len(calls) == 2
    assert encoder.decode(encoder.encode("some text, twice")) == "some text, twice"
