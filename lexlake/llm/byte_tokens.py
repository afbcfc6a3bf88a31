"""Byte-level BPE of whole texts with the tokenizers library, by a table of
distinct pre-tokens.

The pre-tokeniser never joins a space to what stands before it, so the texts of
a batch are cut at spaces, the batch's distinct chunks are looked up in a table,
and ids are gathered back by position. A chunk that the table lacks is split by
the tokenizer's own pattern and each pre-token goes through the library's model.
Texts where white space meets a space, or that hold an added token's own string,
go to the library whole.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402  reads the setting on import

from lexlake.llm import chunks  # noqa: E402

#: Entries held in a worker. A full table keeps what it has, which holds the
#: frequent chunks; further ones are encoded batch by batch.
TABLE_CHUNKS = 800_000
#: The pre-token pattern of byte-level BPE vocabularies of this family (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PUNCTUATION = frozenset(",.;:!?")


def _byte_letters() -> dict[int, str]:
    """Byte → the printable letter that stands for it in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_SPACE = _LETTERS[32]


class IdTable:
    """The tokenizer with a table of chunks: chunk (without the space that it
    follows) → int32 bytes of its ids."""

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.size = self.whole.get_vocab_size()
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self._tokens, self._split = self.whole.model.tokenize, regex.compile(PATTERN).findall
        self.chunks: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}

    def lengths(self) -> np.ndarray:
        """Id → UTF-8 bytes that it stands for: its string has one letter for each."""
        out = np.zeros(self.size, dtype=np.int64)
        for token, i in self.whole.get_vocab().items():
            out[i] = len(token)
        return out

    def _model(self, letters: str) -> bytes:
        return array("i", [t.id for t in self._tokens(letters)]).tobytes()

    def _pre(self, pre: str) -> bytes:
        """Ids of a pre-token that doesn't begin with a space."""
        found = self.inner.get(pre)
        if found is None:
            found = self._model(pre.encode().decode("latin1").translate(_LETTERS))
            if len(self.inner) < TABLE_CHUNKS // 4:
                self.inner[pre] = found
        return found

    def _word(self, word: str) -> bytes:
        """Ids of a space and one run of letters, digits or other characters."""
        found = self.chunks.get(word)
        if found is None:
            bare = word if word.isascii() and word.isprintable() else word.encode().decode("latin1").translate(_LETTERS)
            found = self._model(_SPACE + bare)
            if len(self.chunks) < TABLE_CHUNKS:
                self.chunks[word] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a space and the chunk behind it."""
        if chunk.isalpha():
            return self._word(chunk)
        if chunk[-1:] in _PUNCTUATION and chunk[:-1].isalpha():
            found = self._word(chunk[:-1]) + self._pre(chunk[-1])
        else:
            first, *rest = self._split(" " + chunk)
            head = self._word(first[1:]) if len(first) > 1 and first[0] == " " else self._pre(first)
            found = head + b"".join(map(self._pre, rest))
        if len(self.chunks) < TABLE_CHUNKS:
            self.chunks[chunk] = found
        return found

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("i", e.ids).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, stop row, ids of these texts, where each text's ids end),
        in slices of a batch. Null is empty."""
        for lo, hi, part in chunks.slices(texts):
            yield lo, hi, *self._slice(part)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        names, codes, bounds = chunks.cut(texts)
        first = np.zeros(len(codes), dtype=bool)
        first[bounds[:-1]] = True
        # No cut is safe where white space stands before a space.
        spaced = np.fromiter((not c or c[-1].isspace() for c in names), dtype=bool, count=len(names))
        unsafe = spaced[codes]
        unsafe[bounds[1:] - 1] = False
        whole = np.add.reduceat(unsafe, bounds[:-1]) > 0
        for content in self.added:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)

        behind = np.zeros(len(names), dtype=bool)
        behind[codes[~first]] = True
        known, chunk = self.chunks.get, self._chunk
        held = [(known(c) or chunk(c)) if b else b"" for c, b in zip(names, behind.tolist())]
        heads, which = np.unique(codes[first], return_inverse=True)
        codes[first] = len(names) + which
        held += self._library([names[c] for c in heads.tolist()])

        ids, stop = chunks.gathered(held, codes)
        ends = stop[bounds[1:] - 1]
        if whole.any():
            parts = np.split(ids, ends[:-1])
            rows = np.flatnonzero(whole)
            for row, found in zip(rows.tolist(), self._library(texts.take(pa.array(rows)).to_pylist())):
                parts[row] = np.frombuffer(found, dtype=np.int32)
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, ends


class Spans:
    """Character spans of the tokens of texts."""

    def __init__(self, path: str) -> None:
        self.table = table(path)
        self.size = self.table.lengths()

    def of(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends, as in the library: tokens that are part of one
        character have that character's span each."""
        ends = np.cumsum(self.size[ids])
        starts = ends - self.size[ids]
        if text.isascii():
            return starts, ends
        character = np.cumsum((np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80) - 1
        return character[starts], character[ends - 1] + 1


_TABLES: dict[str, IdTable] = {}


def table(path: str) -> IdTable:
    """The worker's table, kept between its tasks."""
    if path not in _TABLES:
        _TABLES[path] = IdTable(path)
    return _TABLES[path]


def bits_needed(ids: int) -> int:
    """Of the ids 0 .. ids-1."""
    return max(1, (ids - 1).bit_length())
