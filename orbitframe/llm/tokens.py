"""Token ids of whole texts by a public tokenizer, one lookup per chunk between spaces.

The word-end vocabulary lower-cases, drops white space and never merges across it, so the ids of
a text are those of its chunks between spaces, in order. Each frequent chunk is encoded once per
task and then looked up.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer

MAX_CHUNKS = 400_000
_PART = 1 << 18
# a full stop or comma is a token of its own unless another mark stands before it
_JOINED_MARK = re.compile(r"[.,](?<![^\W_][.,])(?<![ \t\n\r\v\f][.,]) ")
# lower-case Latin letters that need no normalisation
_WORD = re.compile("[a-zß-öø-ÿ]+")
# The byte-level alphabet shows a byte that is no printable Latin-1 character as
# the next free code point from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class _Numbers(dict):
    """Chunk -> running number. New chunks queue up; once full, they get passing numbers."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.known = 0

    def __missing__(self, chunk):
        number = self.known + len(self.new)
        self.new.append(chunk)
        if len(self) < MAX_CHUNKS:
            self[chunk] = number
        return number


class ChunkEncoder:
    """Encodes texts with a lower-casing vocabulary that never joins across white space.

    ``plain_specials``: strings of special tokens inside a text are ordinary text.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = plain_specials
        self._specials = [] if plain_specials else [
            t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self._numbers = _Numbers()
        self._flat = np.empty(1 << 16, np.uint32)
        self._start = np.empty(1 << 14, np.int64)
        self._size = np.empty(1 << 14, np.int64)

    def _encode_new(self) -> None:
        new, first = self._numbers.new, self._numbers.known
        got = [self._ids(chunk) for chunk in new]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        base = int(self._start[first - 1] + self._size[first - 1]) if first else 0
        total = int(sizes.sum())
        while base + total > len(self._flat):
            self._flat = np.concatenate([self._flat, np.empty_like(self._flat)])
        while first + len(got) > len(self._size):
            self._start = np.concatenate([self._start, np.empty_like(self._start)])
            self._size = np.concatenate([self._size, np.empty_like(self._size)])
        self._flat[base:base + total] = [i for ids in got for i in ids]
        self._size[first:first + len(got)] = sizes
        self._start[first:first + len(got)] = base + np.cumsum(sizes) - sizes
        self._numbers.known = len(self._numbers)
        self._numbers.new = []

    def _ids(self, chunk: str) -> list[int]:
        if chunk.isalpha() and chunk == chunk.lower() and chunk.isascii():
            return [t.id for t in self._tokenizer.model.tokenize(chunk)]  # one word as it is
        if chunk.isalpha() and _WORD.fullmatch(chunk):
            return [t.id for t in self._tokenizer.model.tokenize(
                chunk.encode().decode("latin-1").translate(_BYTE_SIGNS))]
        return self._tokenizer.encode(chunk, add_special_tokens=False).ids

    def _lookup(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, one after another, and how many each has."""
        at = np.fromiter(map(self._numbers.__getitem__, chunks), np.int64, len(chunks))
        missed = len(self._numbers.new)
        if missed:
            self._encode_new()
        sizes = self._size[at]
        ids = self._flat[np.repeat(self._start[at] - np.cumsum(sizes) + sizes, sizes)
                         + np.arange(int(sizes.sum()))]
        if len(self._numbers) >= MAX_CHUNKS and 2 * missed > len(chunks):
            self._clear()  # other texts than those the table was filled with
        return ids, sizes

    def _chunks(self, text: str) -> list[str]:
        if any(s in text for s in self._specials):
            return text.split(" ")  # a special token counts only as it is written
        if text.isascii() or not ("Σ" in text or "İ" in text) and unicodedata.is_normalized("NFC", text):
            text = text.lower().replace("\n", " ")
        else:
            return text.split(" ")
        if not _JOINED_MARK.search(text):
            text = text.replace(", ", " , ").replace(". ", " . ")
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit numbers."""
        out, chunks, counts = [], [], []

        def flush():
            ids, sizes = self._lookup(chunks)
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *counts])]
            out.extend(ids[a:b] for a, b in zip(ends[:-1], ends[1:]))
            chunks.clear(), counts.clear()

        for text in texts:
            own = self._chunks(text)
            if len(own) > _PART:  # one long text, in parts
                flush()
                parts = [self._lookup(own[i:i + _PART])[0] for i in range(0, len(own), _PART)]
                out.append(np.concatenate(parts))
                continue
            chunks.extend(own)
            counts.append(len(own))
            if len(chunks) > _PART:
                flush()
        flush()
        return out
