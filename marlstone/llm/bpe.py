"""Byte-pair encoding by speculation and verification, and decoding.

A trie proposes for each word the greedy longest tokens. The proposal is what merging would give if
each of its tokens is what merging gives for its own text and if for each adjacent pair no merge
across their border comes before the merges that built them; numpy tests all pairs of all words at
once. Only words that fail are merged exactly, many at a time. Distinct words alone are encoded.

Defined cases: a null or empty text has no ids and decodes to an empty text; special tokens in a
text become their ids; repeated rows are encoded alike, rows with one doc_id or none too; ties can't
occur; a very long text is a chunk of its own; an empty table gives no rows; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from marlstone.llm.common import keyed_text, per_chunk, ranges, words

_NONE = 1 << 40
#: Longer words are merged one by one with a heap.
_TABLE_WIDTH = 48


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


class BpeModel:
    """The merges of a tokenizer file with a byte-level vocabulary; ``end``: its end-of-word suffix."""

    END = 256  # the symbol after a word's last byte

    def __init__(self, vocab: dict[str, int], merges: list, end: str | None):
        letters = _byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.end = bool(end)
        n = max(vocab.values()) + 1
        self.base = np.array([vocab[c] for c in letters], np.int64)
        self.base_end = np.array([vocab[c + end] for c in letters], np.int64) if end else self.base
        self.left, self.right = np.arange(n), np.arange(n)
        keys, made = [], []
        for pair in merges:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.left[z], self.right[z] = x, y
            keys.append(x << 20 | y)
            made.append(z)
        # which merge comes first; ids ascend with it in most vocabularies, but need not
        self.rank = np.full(n, -1, np.int64)
        self.rank[made] = np.arange(len(made))
        order = np.argsort(keys, kind="stable")
        self.keys, self.made = np.append(np.array(keys, np.int64)[order], _NONE), np.append(np.array(made, np.int64)[order], -1)

        def symbols(token: str) -> list[int]:
            ended = bool(end) and token.endswith(end)
            return [byte_of[c] for c in (token[: -len(end)] if ended else token)] + [self.END] * ended

        made_set = {*made, *self.base.tolist(), *self.base_end.tolist()}
        tokens = [(symbols(t), i) for t, i in vocab.items() if i in made_set]
        sure = self._own(tokens)
        self._build_trie([t for t, ok in zip(tokens, sure, strict=True) if ok])

    def _own(self, tokens: list[tuple[list[int], int]]) -> list[bool]:
        """Which tokens merging makes out of their own text; the greedy proposal uses no others."""
        out = [False] * len(tokens)
        inner = [k for k, (s, _) in enumerate(tokens) if s]
        ended = [tokens[k][0][-1] == self.END for k in inner]
        found = self._merge([bytes(tokens[k][0][: -1 if e else None]) for k, e in zip(inner, ended, strict=True)], np.array(ended))
        for k, ids in zip(inner, found, strict=True):
            out[k] = len(ids) == 1 and ids[0] == tokens[k][1]
        return out

    def _build_trie(self, tokens: list[tuple[list[int], int]]) -> None:
        nodes: dict[int, int] = {}
        token = [-1]
        for symbols, i in tokens:
            at = 0
            for s in symbols:
                at = nodes.setdefault(at * 257 + s, len(token))
                if at == len(token):
                    token.append(-1)
            token[at] = i
        self.trie_token = np.array(token, np.int64)
        keys = np.array(list(nodes), np.int64)
        order = np.argsort(keys)
        self.trie_keys, self.trie_next = np.append(keys[order], _NONE), np.append(np.array(list(nodes.values()), np.int64)[order], 0)

    def _step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = node * 257 + symbol
        at = np.searchsorted(self.trie_keys, key)
        return np.where(self.trie_keys[at] == key, self.trie_next[at], -1)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What a and b merge to, -1: they don't."""
        key = a << 20 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def propose(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match over all words: (word, token) in reading order, and which words came through."""
        n = np.diff(starts)
        at, going, fine = np.zeros(len(n), np.int64), np.flatnonzero(n > 0), np.ones(len(n), bool)
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        total = n + self.end
        padded = np.append(text.astype(np.int64), 0)
        while len(going):
            node, step = np.zeros(len(going), np.int64), np.zeros(len(going), np.int64)
            best, length, live = np.full(len(going), -1), np.zeros(len(going), np.int64), np.arange(len(going))
            while len(live):
                w, pos = going[live], at[going[live]] + step[live]
                symbol = np.where(pos < n[w], padded[np.minimum(starts[w] + pos, len(text))], self.END)
                node[live] = self._step(node[live], symbol)
                step[live] += 1
                alive = node[live] >= 0
                live, pos, w = live[alive], pos[alive] + 1, w[alive]
                token = self.trie_token[node[live]]
                good = (token >= 0) & ~((pos == n[w]) & self.end)  # the end symbol must not stay alone
                best[live[good]], length[live[good]] = token[good], step[live[good]]
                live = live[pos < total[w]]
            fine[going[best < 0]] = False
            rounds.append((going[best >= 0], best[best >= 0]))
            going, length = going[best >= 0], length[best >= 0]
            at[going] += length
            going = going[at[going] < total[going]]
        word, token = (np.concatenate(x) for x in zip(*rounds, strict=True)) if rounds else (np.zeros(0, np.int64),) * 2
        order = np.argsort(word, kind="stable")
        return word[order], token[order], fine

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For adjacent tokens: merging leaves their border open.

        Both are unbuilt from their latest merge on; a merge across the border that comes before the
        merge just undone (for the right token: not after it, since merges go from left to right)
        would have been made.
        """
        good, open_ = np.zeros(len(a), bool), np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), _NONE)
        while len(open_):
            x, y = a[open_], b[open_]
            made = self.pair(x, y)
            stays = ~((made >= 0) & (self.rank[made] < limit[open_]))
            open_, x, y = open_[stays], x[stays], y[stays]
            rx, ry = self.rank[x], self.rank[y]
            over = (rx < 0) & (ry < 0)
            good[open_[over]] = True
            open_, x, y, rx, ry = (v[~over] for v in (open_, x, y, rx, ry))
            undo_left = rx > ry
            a[open_] = np.where(undo_left, self.right[x], x)
            b[open_] = np.where(undo_left, y, self.left[y])
            limit[open_] = np.where(undo_left, rx, ry + 1)
        return good

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank, n = self.rank, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        look = lambda i, j: int(self.pair(np.array([ids[i]]), np.array([ids[j]]))[0])
        first = self.pair(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(rank[z]), i, ids[i], ids[i + 1], int(z)) for i, z in enumerate(first.tolist()) if z >= 0]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = z, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (made := look(p, q)) >= 0:
                    heapq.heappush(heap, (int(rank[made]), p, ids[p], ids[q], made))
        return [i for i in ids if i >= 0]

    def _merge(self, texts: list[bytes], ended: np.ndarray | None = None) -> list[list[int]]:
        """Exact merging of whole words, in tables of words of like length."""
        out: list[list[int]] = [[]] * len(texts)
        size = np.array([len(t) for t in texts], np.int64)
        ended = np.full(len(texts), self.end) if ended is None else ended
        for k in np.flatnonzero(size > _TABLE_WIDTH).tolist():
            ids = self.base[np.frombuffer(texts[k], np.uint8)]
            if ended[k]:
                ids[-1] = self.base_end[texts[k][-1]]
            out[k] = self._merge_long(ids.tolist())
        for low, high in ((1, 6), (7, 9), (10, 12), (13, 16), (17, 24), (25, _TABLE_WIDTH)):
            rows = np.flatnonzero((size >= low) & (size <= high))
            for at in range(0, len(rows), 50_000):
                part = rows[at : at + 50_000]
                n = size[part]
                flat = np.frombuffer(b"".join(texts[k] for k in part.tolist()), np.uint8)
                table = np.full((len(part), high + 1), -1, np.int64)
                row = np.repeat(np.arange(len(part)), n)
                table[row, ranges(np.zeros(len(part), np.int64), n)] = self.base[flat]
                last = flat[np.cumsum(n) - 1]
                table[np.arange(len(part)), n - 1] = np.where(ended[part], self.base_end[last], self.base[last])
                n = self._merge_table(table, n)
                for k, r, c in zip(part.tolist(), table.tolist(), n.tolist(), strict=True):
                    out[k] = r[:c]
        return out

    def _merge_table(self, table: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Merges each row's first pair of lowest rank until none is left."""

        def ranks(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            a, b = table[rows, at], table[rows, at + 1]
            made = np.where((a >= 0) & (b >= 0), self.pair(np.maximum(a, 0), np.maximum(b, 0)), -1)
            return np.where(made >= 0, self.rank[made], _NONE)

        width = table.shape[1]
        rank = np.full((len(table), width), _NONE)
        for c in range(width - 1):
            rank[:, c] = ranks(np.arange(len(table)), np.full(len(table), c))
        n, live, columns = n.copy(), np.arange(len(table)), np.arange(width)
        while len(live):
            at = rank[live].argmin(1)
            more = rank[live, at] < _NONE
            live, at = live[more], at[more]
            if not len(live):
                break
            made = self.pair(table[live, at], table[live, at + 1])
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            moved, moved_rank = np.take_along_axis(table[live], source, 1), np.take_along_axis(rank[live], source, 1)
            moved[:, -1], moved_rank[:, -1] = -1, _NONE
            moved[np.arange(len(live)), at] = made
            table[live], rank[live] = moved, moved_rank
            n[live] -= 1
            rank[live, at] = ranks(live, at)
            some = at > 0
            rank[live[some], at[some] - 1] = ranks(live[some], at[some] - 1)
        return n

    def encode_words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of all words in one array, how many each word has, and how many words needed merging."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        word, token, fine = self.propose(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(size)]))
        inner = np.flatnonzero(word[1:] == word[:-1])
        fine[word[inner[~self.compatible(token[inner], token[inner + 1])]]] = False
        count = np.bincount(word, minlength=len(texts))
        failing = np.flatnonzero(~fine)
        if len(failing):
            exact = self._merge([texts[k] for k in failing.tolist()])
            keep = fine[word]
            word = np.concatenate([word[keep], np.repeat(failing, [len(e) for e in exact])])
            token = np.concatenate([token[keep], np.fromiter((i for e in exact for i in e), np.int64)])
            order = np.argsort(word, kind="stable")
            token, count = token[order], np.bincount(word, minlength=len(texts))
        return token, count, len(failing)


class WordBpe:
    """Encodes as a tokenizer file of this shape does: NFC, lower case, white space dropped, words ended by a suffix."""

    #: Pieces inside white space, in the file's order of alternatives; white space itself is dropped.
    ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
    LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\x85\xA0\p{L}\p{N}]+")

    def __init__(self, path: str, limit: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.model = BpeModel(file["model"]["vocab"], file["model"]["merges"], file["model"]["end_of_word_suffix"])
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        names = {i: t for t, i in file["model"]["vocab"].items()} | {i: t for t, i in self.special.items()}
        spelled = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.spelled = np.frombuffer(b"".join(s + b" " for s in spelled), np.uint8)
        self.spelled_size = np.array([len(s) + 1 for s in spelled])
        self.spelled_start = np.cumsum(self.spelled_size) - self.spelled_size
        self._letters = {c: b for b, c in enumerate(_byte_letters())}
        self.limit, self.known, self.starts, self.ids = limit, {}, np.zeros(1, np.int64), np.zeros(0, np.int64)

    def split(self, part: str) -> list[bytes | int]:
        """The words of a part without ASCII white space; special tokens as ids."""
        if "<|" in part and self._special.search(part):
            out: list[bytes | int] = []
            for p in self._special.split(part):
                out += [self.special[p]] if p in self.special else self.split(p)
            return out
        if part.isascii():
            return [m.encode() for m in self.ASCII.findall(part.lower())]
        if max(part) < "ɐ":
            return [m.encode() for m in self.LATIN.findall(part.lower())]
        # rarer letters: the library's own normalisation and cutting
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return [bytes(self._letters[c] for c in p) for p, _ in found]

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [self.split(p) for p in parts]
        number: dict[bytes, int] = {}
        code = np.array([number.setdefault(w, len(number)) if isinstance(w, bytes) else -1 - w for p in pieces for w in p], np.int64)
        of_part = np.repeat(np.arange(len(parts)), [len(p) for p in pieces])
        ids, count, _ = self.model.encode_words(list(number))
        begin = np.cumsum(count) - count
        special = code < 0
        size = np.where(special, 1, count[np.maximum(code, 0)] if len(count) else 1)
        store = np.concatenate([ids, -1 - code[special]])
        start = np.where(special, len(ids) + np.cumsum(special) - 1, begin[np.maximum(code, 0)] if len(count) else 0)
        return np.bincount(of_part, size, len(parts)).astype(np.int64), store[ranges(start, size)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number of ids of each text."""
        distinct, code, counts = words(texts)
        values = distinct.to_pylist()
        known = self.known.get
        at = np.fromiter((known(v, -1) for v in values), np.int64, len(values))
        new = np.flatnonzero(at < 0)
        missing = [values[i] for i in new.tolist()]
        n, ids = self._encode_parts(missing)
        base = len(self.starts) - 1
        at[new] = base + np.arange(len(new))
        starts, store = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n)]), np.concatenate([self.ids, ids])
        if len(self.known) < self.limit:
            self.known.update(zip(missing, range(base, base + len(missing)), strict=True))
            self.starts, self.ids = starts, store
        at = at[code]
        size = starts[at + 1] - starts[at]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        return store[ranges(starts[at], size)], np.diff(ends)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' spellings with a space between, as the library joins them for such a file."""
        return self.spelled[ranges(self.spelled_start[ids], self.spelled_size[ids])].tobytes()[:-1]


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (32-bit little-endian ids), decoded_sha256."""

    def make():
        bpe = word_bpe(path)

        def run(part: pa.RecordBatch) -> dict:
            ids, n = bpe.encode(part.column("text"))
            ends, wide = np.cumsum(n), ids.astype("<u4")
            spans = list(zip((ends - n).tolist(), ends.tolist(), strict=True))
            return {
                "doc_id": part.column("doc_id"),
                "n_tokens": n,
                "ids_sha256": [hashlib.sha256(wide[b:e]).hexdigest() for b, e in spans],
                "decoded_sha256": [hashlib.sha256(bpe.decode(ids[b:e])).hexdigest() for b, e in spans],
            }

        return run

    return per_chunk(keyed_text(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
