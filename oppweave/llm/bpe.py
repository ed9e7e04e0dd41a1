"""Byte-pair encoding and decoding of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import give_back
from .vocabulary import MARKS, Memo, Vocabulary, byte_alphabet, load, plain_word, share

KEPT = 600_000  # pieces whose ids a worker remembers


class Encoder:
    """Encodes and decodes texts; words met before are looked up.

    Texts are cut at single spaces that stand between other characters. A word never
    holds such a space but as its first character, so the pieces can be encoded one
    by one and their ids kept. Pieces at longer white space are left together.
    """

    def __init__(self, vocabulary: Vocabulary):
        if vocabulary.word_end:
            raise ValueError("a vocabulary with word ends drops white space and cannot be decoded")
        self.vocabulary = vocabulary
        self._packed = [i.to_bytes(4, "little") for i in range(max(vocabulary.strings) + 1)]
        self._words = Memo(self._encode_word, KEPT // 6)
        self._space = next(c for c, b in byte_alphabet().items() if b == 0x20)
        self._pieces = Memo(self._encode_piece, KEPT)
        alphabet = byte_alphabet()
        self._bytes = np.full(len(self._packed), b"", dtype=object)
        for i, s in vocabulary.strings.items():
            known = i not in vocabulary.special.values() and all(c in alphabet for c in s)
            self._bytes[i] = bytes(map(alphabet.__getitem__, s)) if known else s.encode()

    def keep(self, pieces: int) -> None:
        """Remember at most so many pieces from now on."""
        self._pieces.half = pieces // 2

    def forget(self) -> None:
        """Drop all remembered pieces and words."""
        for memo in (self._pieces, self._words):
            memo.clear()
            memo.old = {}

    def _encode_word(self, word: str) -> bytes:
        return b"".join(map(self._packed.__getitem__, self.vocabulary.encoded(word)))

    def _encode_piece(self, piece: str) -> bytes | None:
        if piece.isascii() and piece.isalpha():
            return self._encode_word(self._space + piece)
        if (word := plain_word(piece)) is not None:
            return self._encode_word(self._space + word)
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        word = piece.rstrip(MARKS)
        if word and len(word) < len(piece) and plain_word(word) is not None:
            return self._pieces[word] + self._words[piece[len(word) :]]
        return self._encode_whole(" " + piece)

    def _encode_whole(self, text: str) -> bytes:
        return b"".join(map(self._words.__getitem__, self.vocabulary.words(text)))

    def _encode_section(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if rest and first and not first[-1].isspace():
            ids = list(map(self._pieces.__getitem__, rest))
            if None not in ids:
                return self._encode_whole(first) + b"".join(ids)
        return self._encode_whole(text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        special = self.vocabulary.special
        return b"".join(
            special[s].to_bytes(4, "little") if k % 2 else self._encode_section(s)
            for k, s in enumerate(self.vocabulary.sections(text))
            if s
        )

    def decode(self, ids: bytes) -> str:
        """Concatenate the vocabulary's strings; their characters stand for bytes."""
        return b"".join(self._bytes[np.frombuffer(ids, dtype="<u4")].tolist()).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of each whole text, as binary: little-endian unsigned 32-bit integers.

    Nulls count as empty texts and give no ids; equal texts give equal ids. Special
    strings inside texts become their ids, as in the library's default. Other columns
    pass through; a column that has the name ``ids`` is replaced. Rows are not moved.
    """
    shared = share(docs.sparkSession, path)

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        encoder = load(Encoder, shared.value)
        return pa.array([encoder.encode(t or "") for t in texts.to_pylist()], pa.binary())

    return docs.withColumn(ids, run(F.col(text)))


def decode(rows: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids; nulls count as no ids, bytes that are no UTF-8 become U+FFFD."""
    shared = share(rows.sparkSession, path)

    @F.arrow_udf("string")
    def run(arrays: pa.Array) -> pa.Array:
        encoder = load(Encoder, shared.value)
        return pa.array([encoder.decode(a or b"") for a in arrays.to_pylist()], pa.string())

    return rows.withColumn(text, run(F.col(ids)))


def round_trip(
    docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded", kept: int = KEPT
) -> DataFrame:
    """:func:`encode` and :func:`decode` in one function, so that a task keeps one worker and its remembered pieces.

    Columns of ``docs`` with the names ``ids`` and ``decoded`` are replaced. A worker remembers up to ``kept`` pieces
    (about 250 bytes each) until its task ends; a smaller number costs time.
    """
    return _with_both(docs, path, text, kept, ids, decoded, "string", lambda texts, back: pa.array(back, pa.string()))


def checked(
    docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", same: str = "round_trip", kept: int = KEPT
) -> DataFrame:
    """Like :func:`round_trip`, but with a boolean in place of the decoded text: whether it equals the text (null: empty)."""
    return _with_both(
        docs, path, text, kept, ids, same, "boolean",
        lambda texts, back: pa.array([t == b for t, b in zip(texts, back)], pa.bool_()),
    )


def _with_both(docs: DataFrame, path: str, text: str, kept: int, first: str, second: str, kind: str, made) -> DataFrame:
    """``docs`` with the ids of the texts and what ``made`` gives for texts and decoded texts."""
    shared = share(docs.sparkSession, path)

    @F.arrow_udf(f"struct<ids:binary,other:{kind}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = load(Encoder, shared.value)
        encoder.keep(kept)
        for column in batches:
            texts = [t or "" for t in column.to_pylist()]
            coded = list(map(encoder.encode, texts))
            arrays = [pa.array(coded, pa.binary()), made(texts, map(encoder.decode, coded))]
            yield pa.StructArray.from_arrays(arrays, names=["ids", "other"])
        encoder.forget()
        give_back()

    # The row travels as one struct, so that no column of it can have the name of the result.
    both = docs.select(F.struct("*").alias("row"), run(F.col(text).cast("string")).alias("coded"))
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in (first, second)]
    return both.select(*others, F.col("coded.ids").alias(first), F.col("coded.other").alias(second))
