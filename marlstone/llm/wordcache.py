"""Encoding of whole texts by the tokenizers library, once for each distinct word.

A byte-level pre-tokenizer always starts a new piece at a single space between two characters that
aren't white space, so a text may be cut there and the parts encoded apart: the concatenated ids are
those of the whole text. Arrow cuts and numbers the words; the library encodes the new ones of a
chunk, many in one call; a bounded cache in Arrow arrays keeps them from one chunk to the next.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from marlstone.llm.common import ranges

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Words that the library gets in one text.
_CALL = 5_000


class WordEncoder:
    """``path``: a tokenizer file with a byte-level pre-tokenizer. ``limit``: from so many words on, the cache takes no more."""

    def __init__(self, path: str, limit: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if hasattr(self.tokenizer.model, "_resize_cache"):  # no word comes twice, so the library needn't keep any
            self.tokenizer.model._resize_cache(0)
        self.limit = limit
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        #: Ids whose token begins with a space, as every word that follows a space does.
        self.begins = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.begins[number] = token.startswith("Ġ")
        #: An added token that takes white space with it may reach over a cut.
        self.whole = any(t.lstrip or t.rstrip or any(map(str.isspace, t.content)) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.known, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def _library(self, pieces: list[str]) -> pa.Array:
        """The ids of each piece."""
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return pa.array([np.array(e.ids, self.dtype).tobytes() for e in found], pa.large_binary())

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of words, none of which is empty or holds a space, begins or ends with white space, after a space."""
        out = [pa.array([], pa.large_binary())]
        for at in range(0, len(words), _CALL):
            part = words.slice(at, _CALL).to_pylist()
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            first = np.flatnonzero(self.begins[ids])
            if len(first) == len(part) and first[0] == 0:
                ends = np.append(first, len(ids)) * self.dtype.itemsize
                out.append(pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]))
            else:
                out.append(self._library([" " + w for w in part]))
        return pa.concat_arrays(out)

    def _codes(self, parts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Each part's place in the cache or behind it (-1: empty, or white space at an edge), the new words, their ids."""
        numbered = parts.dictionary_encode()
        place = pc.index_in(numbered.dictionary, value_set=self.known)
        fresh = pc.is_null(place)
        new = numbered.dictionary.filter(fresh)
        fresh = np.flatnonzero(fresh.to_numpy(zero_copy_only=False))
        place = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        plain = pc.and_(pc.equal(pc.utf8_trim_whitespace(new), new), pc.not_equal(new, "")).to_numpy(zero_copy_only=False)
        good = np.flatnonzero(plain)
        words = new.take(pa.array(good))
        place[fresh] = -1
        place[fresh[good]] = len(self.known) + np.arange(len(good))
        return place[numbered.indices.to_numpy(zero_copy_only=False)], words, self._words(words)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number of ids of each text. Texts aren't null."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.whole:
            return self._joined(self._library(texts.to_pylist()), np.arange(len(texts)), np.arange(len(texts)))
        lists = pc.split_pattern(texts, " ")
        flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(counts) - counts
        code, words, ids = self._codes(flat)
        # a text's first part has no space before it; it may be empty, then the text begins with a space
        heads = flat.take(pa.array(first))
        code[first[pc.equal(heads, "").to_numpy(zero_copy_only=False)]] = 0
        odd = np.flatnonzero(np.add.reduceat(code < 0, first))
        extra: list[str] = []
        if len(odd):  # parts with white space at an edge: these texts are cut at other places only
            cut = [_CUT.split(t) for t in texts.take(pa.array(odd)).to_pylist()]
            size = np.fromiter(map(len, cut), np.int64, len(cut))
            extra = [" " + p if k else p for x in cut for k, p in enumerate(x)]
        store = pa.concat_arrays([self.ids, ids, self._library(heads.to_pylist()), self._library(extra)])
        behind = len(self.known) + len(words)
        code[first] = behind + np.arange(len(texts))
        if len(odd):
            own = np.arange(len(extra)) + behind + len(texts)
            pieces, all_ = counts.copy(), np.concatenate([code, own])
            begin = first.copy()
            pieces[odd], begin[odd] = size, len(code) + np.cumsum(size) - size
            code, counts = all_[ranges(begin, pieces)], pieces
            first = np.cumsum(counts) - counts
        if len(self.known) < self.limit:
            self.known, self.ids = pa.concat_arrays([self.known, words]), pa.concat_arrays([self.ids, ids])
        out = self._joined(store, code, first)
        pa.default_memory_pool().release_unused()
        return out

    def _joined(self, store: pa.Array, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        taken = store.take(pa.array(code))
        _, offsets, data = taken.buffers()
        ends = np.frombuffer(offsets, np.int64)[taken.offset : taken.offset + len(taken) + 1] // self.dtype.itemsize
        ids = np.frombuffer(data, self.dtype)[ends[0] : ends[-1]] if data is not None else np.zeros(0, self.dtype)
        return ids, np.diff(np.append(ends[first], ends[-1]))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks that a worker runs."""
    return WordEncoder(path)
