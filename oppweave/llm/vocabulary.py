"""Tokenizer files: read once on the driver, sent as a broadcast of fixed size, parsed once per worker."""

from __future__ import annotations

import hashlib
import json
import re
import string
from functools import cached_property
from itertools import chain
from operator import add

from pyspark import Broadcast
from pyspark.sql import SparkSession

from .files import give_back
from .merging import merge


def byte_alphabet() -> dict[str, int]:
    """Character of each byte: printable Latin-1 ones stand for themselves, the rest follow from 256 on."""
    plain = set(chain(range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100)))
    others = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


#: ASCII marks of which a run at the end of a word is a word of its own in every known splitting.
MARKS = string.punctuation.replace("'", "")
_TO_ALPHABET = {b: c for c, b in byte_alphabet().items()}


def plain_word(piece: str) -> str | None:
    """A piece of Latin-1 letters in the byte alphabet, or None. Such a piece is one word, and in normal form C."""
    if piece.isalpha() and (piece.isascii() or max(piece) <= "\xff"):
        return piece if piece.isascii() else piece.encode().decode("latin-1").translate(_TO_ALPHABET)
    return None


class Vocabulary:
    """A BPE tokenizer file: vocabulary, merge ranks, special strings, and the library's text splitting.

    Splitting of text into words (normalizer and pre-tokenizer) is the library's;
    the merges are left to the operators.
    """

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        give_back()  # what the library needed to read the file, before the file is read once more
        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.word_end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: rank of a pair of symbols under left << 20 | right, and the symbol that each rank makes
        self.merges: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            self.merges[self.ids[a] << 20 | self.ids[b]] = rank
            self.made.append(self.ids[a + b])

        #: rank of a pair of single characters
        self._first = {a + b: rank for rank, (a, b) in enumerate(pairs) if len(a) == 1 and len(b) == 1}

    def merged(self, symbols: list[int]) -> list[int]:
        """The encoding of a run of symbols."""
        get = self.merges.get
        ranks = [get(a << 20 | b) for a, b in zip(symbols, symbols[1:])]
        return merge(symbols[:], ranks, self.merges, self.made)

    def encoded(self, word: str) -> list[int]:
        """The encoding of a word, in a vocabulary without word ends."""
        symbols = list(map(self.ids.__getitem__, word))
        ranks = list(map(self._first.get, map(add, word, word[1:])))
        return merge(symbols, ranks, self.merges, self.made)

    @cached_property
    def strings(self) -> dict[int, str]:
        return {i: s for s, i in (self.ids | self.special).items()}

    @cached_property
    def _special_pattern(self) -> re.Pattern | None:
        names = sorted(self.special, key=len, reverse=True)
        return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def sections(self, text: str) -> list[str]:
        """The text cut at special strings; these stand at the odd places."""
        if self._special_pattern is None or not any(s in text for s in self.special):
            return [text]
        return self._special_pattern.split(text)

    def words(self, text: str) -> list[str]:
        """Words of a section in the alphabet of the vocabulary."""
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def symbols(self, word: str) -> list[int]:
        """Ids of a word's single characters, the last one with the word end where the vocabulary has one."""
        ids = self.ids
        return [ids[c] for c in word[:-1]] + [ids[word[-1] + self.word_end]]


def share(spark: SparkSession, path: str) -> Broadcast:
    """Broadcast of a tokenizer file's text (1.7 MB at most for the known files, whatever the input)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


_LOADED: dict[tuple[type, str], object] = {}


def load(kind: type, text: str):
    """An object made from a tokenizer file's text, kept for the worker's later tasks."""
    key = kind, hashlib.sha1(text.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = kind(Vocabulary(text))
        give_back()
    return _LOADED[key]


class Memo(dict):
    """Values computed on first use, of at most ``limit`` keys.

    When half of them are held they become the old half, and what is asked for again comes back from there. So
    keys in use stay, and the others go; no value depends on it.
    """

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.half, self.old = make, limit // 2, {}

    def __missing__(self, key):
        value = self.old.get(key, self)
        if value is self:
            value = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
