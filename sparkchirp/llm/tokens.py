"""Token ids of whole texts by the ``tokenizers`` library, chunk by chunk.

For the two kinds of vocabulary used here a text may be cut between a word and the white space after it
without changing its ids, so the library encodes each distinct chunk once and a bounded memory holds the
ids.  Texts with white space other than space and newline, or with the string of an added token (which the
library looks for first), go to the library whole.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa

from .common import ChunkMemo

#: White space in any sense of the libraries, besides space and newline, and characters used as marks here.
_ODD = re.compile("[\x00\t\x0b\x0c\r\x1c-\x1f\x85\xa0 ᠎ -‍ -  ⁠　﻿]").search
_RUNS = re.compile("[ \n]*[^ \n]+|[ \n]+").findall


#: Characters whose lower case depends on nothing around them and survives composition.
_LATIN = re.compile("[^\x01-\u024f]").search
#: Characters that no pre-tokenizer joins a full stop or comma to.
_PLAIN = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_JOIN = 64  # chunks encoded in one call
_JOIN_LETTERS = 512  # of letters alone


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it shows, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def ends_in_letter(word: str) -> bool:
    """Is the last character a letter, also once composed and in lower case (some become a letter and a mark)?"""
    c = word[-1:]
    return c.isalpha() and (c.isascii() or unicodedata.normalize("NFC", c).lower()[-1].isalpha())


class Encoder:
    """Packed little-endian ids (``width`` bytes each) of whole texts."""

    def __init__(self, path: str, width: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.width = width or (2 if size <= 1 << 16 else 4)
        self.kind = f"<u{self.width}"
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        self.drops_space = ids(" \n ") == []
        # words of letters are one token of the pre-tokenizer and need no normaliser: the model alone encodes them,
        # many in a call, told apart by the bytes of their tokens (letters of tokens stand for bytes)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = str.maketrans(byte_letters() | {10: " "})
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.bytes_in = np.zeros(size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_in[i] = len(token.removesuffix(suffix) if suffix else token)
        self.folds_case = self.drops_space and ids("ABC É") == ids("abc é")
        if self.drops_space:
            self.mark = next((m for m in "¤§¦¬¶±¸·¯¥¢×÷†‡•€™→■★" if len(ids(m)) == 1 and ids(f"a {m} a") == ids("a") + ids(m) + ids("a")), None)
            self.mark_id = ids(self.mark)[0] if self.mark else None
            self.memo = ChunkMemo(self._words, self.kind, self._word_parts)
        else:
            self.memo = ChunkMemo(self._runs, self.kind, self._run_parts)

    def _library(self, chunks: list[str]) -> list[bytes]:
        kind = self.kind
        return [np.array(x.ids, kind).tobytes() for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _by_bytes(self, tokenizer, texts: list[str], parts: list[list[str]]) -> dict[str, bytes]:
        """Ids of the chunks of each text, told apart by their bytes."""
        look: dict[str, bytes] = {}
        for part, got in zip(parts, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.int64)
            at = (np.searchsorted(np.cumsum(self.bytes_in[ids]), np.cumsum([len(c.encode()) for c in part])) + 1) * self.width
            packed = ids.astype(self.kind).tobytes()
            look.update((c, packed[a:b]) for c, a, b in zip(part, [0, *at[:-1].tolist()], at.tolist(), strict=True))
        return look

    def _of_letters(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks of letters (with one space before, where the vocabulary keeps it)."""
        parts = [chunks[i : i + _JOIN_LETTERS] for i in range(0, len(chunks), _JOIN_LETTERS)]
        return self._by_bytes(self.model, ["\n".join(x).encode().decode("latin-1").translate(self.letters) for x in parts], parts)

    def _words(self, chunks: list[str]) -> list[bytes]:
        """Ids of words: letters by the model alone, others many in a call with a mark between them whose id tells them apart."""
        look = self._of_letters([c for c in chunks if c.isalpha() and c.islower() and not _LATIN(c)])
        rest = [c for c in chunks if c not in look]
        marked = [c for c in rest if self.mark and self.mark not in c]
        gap = f" {self.mark} "
        lists = [marked[i : i + _JOIN] for i in range(0, len(marked), _JOIN)]
        for part, got in zip(lists, self.tokenizer.encode_batch_fast([gap.join(x) for x in lists], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, self.kind)
            at = np.flatnonzero(ids == self.mark_id).tolist()
            if len(at) == len(part) - 1:
                look.update((c, ids[a + 1 : b].tobytes()) for c, a, b in zip(part, [-1, *at], [*at, len(ids)], strict=True))
        rest = [c for c in rest if c not in look]
        look.update(zip(rest, self._library(rest), strict=True))
        return [look[c] for c in chunks]

    def _runs(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks: a space and letters by the model alone, a space and other characters many in a call."""
        look = self._of_letters([c for c in chunks if c[0] == " " and c[1:].isalpha() and not _LATIN(c)])
        plain = [c for c in chunks if c not in look and len(c) > 1 and c[0] == " " and c[1] not in " \n"]
        lists = [plain[i : i + _JOIN] for i in range(0, len(plain), _JOIN)]
        look |= self._by_bytes(self.tokenizer, ["".join(x) for x in lists], lists)
        rest = [c for c in chunks if c not in look]
        look.update(zip(rest, self._library(rest), strict=True))
        return [look[c] for c in chunks]

    def _word_parts(self, word: str) -> tuple[str, ...]:
        """Case folded where that is safe (the string of an added token may not come of it), and a full stop or comma after a letter apart."""
        if self.folds_case and not word.islower() and not _LATIN(word):
            small = word.lower()
            if word.isalpha() or not any(s in small for s in self.special):
                word = small
        if len(word) > 1 and word[-1] in ".," and ends_in_letter(word[:-1]):
            return word[:-1], word[-1]
        return (word,)

    @staticmethod
    def _run_parts(chunk: str) -> tuple[str, ...]:
        """A full stop or comma after a letter apart."""
        if len(chunk) > 1 and chunk[-1] in ".," and chunk[-2].isalpha():
            return chunk[:-1], chunk[-1]
        return (chunk,)

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(chunks of all texts, where each text's begin): cut before white space and before a full stop or comma that ends a
        word; without the white space where the vocabulary drops it."""
        column = pa.array(texts, pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(texts) + 1)
        data = np.frombuffer(column.buffers()[2], np.uint8, int(offsets[-1])) if offsets[-1] else np.zeros(0, np.uint8)
        space = (data == 32) | (data == 10)
        ends = np.append(space[1:], True)
        ends[offsets[1:][offsets[1:] > 0] - 1] = True
        cut = (data == 46) | (data == 44)
        cut &= ends
        cut[1:] &= _PLAIN[data[:-1]]
        cut |= space
        if self.drops_space:
            cut[1:] |= space[:-1]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        begin = np.flatnonzero(cut)
        first = np.searchsorted(begin, offsets)
        chunks = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(data))
        if self.drops_space:
            keep = ~space[begin]
            first = np.append(0, np.cumsum(keep))[first]
            chunks = chunks.filter(pa.array(keep))
        return chunks, first

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, in order."""
        cut: list[str] = []
        ways = []  # of every text: 0 cut, 1 cut by a pattern, 2 whole
        runs, whole = [], []
        for x in texts:
            small = x.lower() if self.folds_case and x.isascii() else x  # once for all words
            if _ODD(x) or any(s in x or s in small for s in self.special):
                ways.append(2)
                whole.append(x)
            elif not self.drops_space and ("   " in (flat := x.replace("\n", " ")) or flat.endswith("  ")):
                ways.append(1)
                runs.append(_RUNS(x))
            else:
                ways.append(0)
                cut.append(small)
        done = [iter(self.memo.packed_chunks(*self._cut(cut))), iter(self.memo.packed_lists(runs)), iter(self._library(whole))]
        return [next(done[w]) for w in ways]


@functools.lru_cache(4)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, built once a process."""
    return Encoder(path)
