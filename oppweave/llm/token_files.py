"""Token ids in files of independent zstandard frames with a trailing seek table.

Layout of a file: the ids of its documents, one after the other, cut every
``FRAME`` bytes and compressed as frames of their own; then frames with the document
table; then a frame with its sizes; then the seek table of the zstandard seekable format, a skippable frame that
lists each frame's compressed size, raw size and checksum (low half of xxh64). A reader
fetches the tail, then only the frames that hold the documents it wants.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import Ranges, by_file, create, shared_folder, stored, task_file
from .vocabulary import MARKS, Memo, Vocabulary, load, plain_word, share

# Fixed values of the zstandard seekable format.
SKIPPABLE, SEEKABLE, CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80

FRAME = 1 << 18  # raw bytes of a frame
FILE_BYTES, FILE_DOCUMENTS = 1 << 28, 1 << 20  # of ids and documents, at which a file is closed and a new one begun
KEPT = 800_000  # pieces whose ids a worker remembers
BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
_TABLE = struct.Struct("<QQI")  # documents, raw bytes of all ids, bytes of an id


class Writer:
    """Writes one file, holding one frame and the document table in memory."""

    def __init__(self, out: BinaryIO, id_bytes: int):
        import zstandard

        self._out, self._width = out, id_bytes
        self._press = zstandard.ZstdCompressor(level=3, write_checksum=False)
        self._raw, self._frames = bytearray(), []
        self._keys, self._lengths, self.size = [], [], 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self._raw += ids.astype(f"<u{self._width}").tobytes()
        self.size += len(ids) * self._width
        self._keys.append(key)
        self._lengths.append(len(ids))
        while len(self._raw) >= FRAME:
            self._frame(self._raw[:FRAME])
            del self._raw[:FRAME]

    def full(self) -> bool:
        return self.size >= FILE_BYTES or len(self._keys) >= FILE_DOCUMENTS

    def _frame(self, raw: bytes) -> None:
        import xxhash

        pressed = self._press.compress(bytes(raw))
        self._out.write(pressed)
        self._frames.append((len(pressed), len(raw), xxhash.xxh64_intdigest(bytes(raw)) & 0xFFFFFFFF))

    def close(self) -> tuple[int, int]:
        """Documents and ids of the file."""
        if self._raw:
            self._frame(self._raw)
        total = sum(self._lengths)
        table = np.array([k is None for k in self._keys], dtype="u1").tobytes()
        table += np.array([k or 0 for k in self._keys], dtype="<i8").tobytes()
        table += np.array(self._lengths, dtype="<u8").tobytes()
        for start in range(0, len(table), FRAME):
            self._frame(table[start : start + FRAME])
        self._frame(_TABLE.pack(len(self._keys), total * self._width, self._width))
        entries = b"".join(struct.pack("<III", *f) for f in self._frames)
        body = entries + struct.pack("<IBI", len(self._frames), CHECKED, SEEKABLE)
        self._out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self._out.close()
        return len(self._keys), total


class Reader:
    """Reads documents of one file by ranges; every frame it touches is checked."""

    def __init__(self, read: Ranges):
        import zstandard

        self._read, self._unpress = read, zstandard.ZstdDecompressor()
        count, _, magic = read.unpack("<IBI", read.size - 9)
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        table = np.frombuffer(read(read.size - 9 - 12 * count, 12 * count), dtype="<u4").reshape(count, 3)
        self._sums = table[:, 2]
        self._at = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        self._raw_at = np.concatenate([[0], np.cumsum(table[:, 1], dtype=np.int64)])
        self._last: tuple[int, bytes] = (-1, b"")
        docs, raw, self.width = _TABLE.unpack(self._frame(count - 1))
        body = self.bytes(raw, int(self._raw_at[-2]))
        empty = np.frombuffer(body, dtype="u1", count=docs).astype(bool)
        keys = np.frombuffer(body, dtype="<i8", count=docs, offset=docs)
        self.lengths = np.frombuffer(body, dtype="<u8", count=docs, offset=9 * docs).astype(np.int64)
        self.keys = [None if e else int(k) for k, e in zip(keys, empty)]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def _frame(self, k: int) -> bytes:
        import xxhash

        if self._last[0] != k:
            pressed = self._read(int(self._at[k]), int(self._at[k + 1] - self._at[k]))
            raw = self._unpress.decompress(pressed, max_output_size=int(self._raw_at[k + 1] - self._raw_at[k]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self._sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self._last = k, raw
        return self._last[1]

    def bytes(self, start: int, end: int) -> bytes:
        """A range of the raw bytes, from the frames that hold it."""
        if start == end:
            return b""
        first = int(np.searchsorted(self._raw_at, start, "right")) - 1
        parts, k = [], first
        while self._raw_at[k] < end:
            at = int(self._raw_at[k])
            parts.append(self._frame(k)[max(0, start - at) : end - at])
            k += 1
        return b"".join(parts)

    def ids(self, document: int) -> np.ndarray:
        """Ids of the document at a place of the table."""
        a, b = int(self.starts[document]) * self.width, int(self.starts[document + 1]) * self.width
        return np.frombuffer(self.bytes(a, b), dtype=f"<u{self.width}")


class LibraryEncoder:
    """The library's own encoder, called once per distinct piece of text between single spaces.

    A word of a byte-level vocabulary holds such a space only as its first character,
    so pieces can be encoded one by one. Texts with other white space next to spaces,
    with special strings or of other splittings go to the library whole.
    """

    def __init__(self, vocabulary: Vocabulary):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        self._library = vocabulary.library
        self._library.no_truncation()
        self._library.no_padding()
        self._special = tuple(vocabulary.special)
        self._by_spaces = vocabulary.words("a bc  d") == ["a", "Ġbc", "Ġ", "Ġd"]
        self._starts = np.zeros(max(vocabulary.strings) + 1, dtype=bool)
        for i, string in vocabulary.strings.items():
            self._starts[i] = string.startswith("Ġ")
        self._pieces: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._alone = all(vocabulary.words(f"a bc{m}{m} d") == ["a", "Ġbc", m + m, "Ġd"] for m in MARKS)
        self._marks = Memo(lambda marks: self._run([marks])[0], KEPT // 100)

    def _run(self, texts: list[str]) -> list[bytes]:
        found = self._library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _cut(self, text: str) -> list[str] | None:
        """Pieces between single spaces, or None where a space has other white space beside it or an end."""
        if not self._by_spaces or any(s in text for s in self._special):
            return None
        if not text or text[0] == " " or text[-1] == " " or "  " in text:
            return None
        if any(b in text and (b + " " in text or " " + b in text) for b in BLANKS):
            return None
        return text.split(" ")

    def _run_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without spaces: many in one text, cut again at the tokens that start with a space."""
        out = []
        joined = [" " + " ".join(pieces[k : k + 500]) for k in range(0, len(pieces), 500)]
        for raw in self._run(joined):
            cuts = (np.flatnonzero(self._starts[np.frombuffer(raw, dtype="<u4")]) * 4).tolist() + [len(raw)]
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self._cut(t) for t in texts]
        first = self._run([t if c is None else c[0] for t, c in zip(texts, cut)])
        rest = [c[1:] if c else [] for c in cut]
        self._learn(set().union(*rest))
        known = self._pieces.__getitem__
        return [a + b"".join(map(known, own)) for a, own in zip(first, rest)]

    def _learn(self, wanted: set[str]) -> None:
        new = wanted.difference(self._pieces)
        # At half of the limit the pieces become the old half; those in use come back from there.
        if len(self._pieces) + len(new) > KEPT // 2:
            self._old, self._pieces, new = self._pieces, {}, wanted
        if not new:
            return
        known, old = self._pieces, self._old
        again = [p for p in new if p in old]
        known.update(zip(again, map(old.__getitem__, again)))
        new = new.difference(known)
        # Marks after a word are a word of their own, so the word's ids serve with and without them.
        heads = {p: h for p in new if (h := p.rstrip(MARKS)) != p and plain_word(h) is not None} if self._alone else {}
        plain = list(new.difference(heads).union(heads.values()).difference(known))
        known.update(zip(plain, self._run_pieces(plain), strict=True))
        known.update((p, known[h] + self._marks[p[len(h) :]]) for p, h in heads.items())


def write_token_files(
    docs: DataFrame, path: str, end_id: int, folder: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode whole texts with the library and write their ids in ascending order of ``key``; return the files.

    Each document's ids are followed by ``end_id``. Files hold ranges of keys that do not overlap, and end at
    ``FILE_BYTES`` of ids or ``FILE_DOCUMENTS``; the table
    returned is written and has a row per file: ``file, n_docs, n_tokens, start`` (ids in all files before it).
    Null keys come first, rows of one key in the order of their texts' hashes; null texts are empty. The range
    is taken over key and hash, so one key with many rows is split as well.
    """
    spark = docs.sparkSession
    shared = share(spark, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, out, made = load(LibraryEncoder, shared.value), None, []
        width = 2 if encoder._library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        end = np.array([end_id], dtype="<u4")
        task = TaskContext.get().partitionId()

        def close() -> None:
            made.append((task, len(made), name, *out.close()))

        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                texts = [t or "" for t in part["t"].to_pylist()]
                for k, ids in zip(part["k"].to_pylist(), encoder.encode(texts)):
                    if out is not None and out.full():
                        close()
                        out = None
                    if out is None:
                        name = task_file(folder, ".ids.zst", len(made))
                        out = Writer(create(name), width)
                    out.add(k, np.concatenate([np.frombuffer(ids, dtype="<u4"), end]))
        if out is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names=["task", "part", "file", "n_docs", "n_tokens"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t").asc()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    files = stored(dealt.mapInArrow(write, "task long, part long, file string, n_docs long, n_tokens long"), "files")
    # One narrow row per file of up to FILE_BYTES: the running sum is over file sizes only.
    before = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    return files.select(
        "file", "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start")
    )


def read_token_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Documents of token files: ``key, start`` (ids before it in all files), ``ids`` (uint32 little-endian binary)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(batch["file"].to_pylist(), batch["start"].to_pylist()):
                with Ranges(file) as ranges:
                    reader = Reader(ranges)
                    for at in range(0, len(reader.keys), 512):
                        some = range(at, min(at + 512, len(reader.keys)))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(reader.keys[at : at + 512], pa.int64()),
                                pa.array([first + int(reader.starts[i]) for i in some], pa.int64()),
                                pa.array([reader.ids(i).astype("<u4").tobytes() for i in some], pa.binary()),
                            ],
                            names=["key", "start", "ids"],
                        )

    return by_file(files, "file").mapInArrow(read, "key long, start long, ids binary")


def token_file_folder(spark: SparkSession) -> str:
    return shared_folder(spark, "ids")
