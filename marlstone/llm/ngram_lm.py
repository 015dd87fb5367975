"""A trigram language model as an Elias-Fano trie in memory-mapped files.

Level 1 holds the words' 64-bit hashes, ascending; a word's id is its place. Level 2 holds, for
ranges of pairs (several where one first word has many), where each word's successors begin (monotone pointers) and the successors'
ids, made monotone by adding what the word before ended with. Level 3 does the same for pairs; there
a third word is not its id but its place among the successors of the second, which is small: a
context-relative id, found by successor search in the ranges of the shorter context. Probabilities
and back-off weights are 16-bit steps of log10.

Probabilities interpolate with absolute discounting: counts are of the whole training part, every
n-gram of it is stored, those that occur once too, and single words have the additive estimate that
also serves as the base score.

Defined cases: a null or empty text is one end token; without any training row all words are unknown
and every score is 0; repeated rows count each; a null doc_id is in the training part if the crc32 of
an empty text is; ties can't occur; a very long text is a chunk of its own; an empty table gives no
rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cached, chunks, get_arrays, keyed_text, over_chunks, put_arrays, release, remainder, remove, shared_dir, string_bytes, words
from marlstone.llm.eliasfano import EliasFano

#: No word holds white space, so this names the end of a text.
_END = pa.array(["\n"])
_STEP = 4096.0
_TOKENS = 4 << 20  # bytes of ids that a task handles at a time
_SHORT = 4  # successors that are read one after the other
_SEEDS = 8


def _quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * _STEP), 0, 65535).astype(np.uint16)


def _value(steps: np.ndarray) -> np.ndarray:
    return steps.astype(np.float64) / -_STEP


def _monotone(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """value + 1 + what the group before ended with; ``group`` ascends, values ascend in it."""
    if not len(value):
        return value.astype(np.uint64)
    last = np.flatnonzero(np.append(group[1:] != group[:-1], True))
    ends = np.cumsum(value[last].astype(np.uint64) + np.uint64(1))
    of = np.searchsorted(last, np.arange(len(value)))
    return value.astype(np.uint64) + np.uint64(1) + np.where(of > 0, ends[of - 1], np.uint64(0))


class Successors:
    """Ranges of a monotone sequence, one for each context; ``find`` looks values up in their contexts' ranges."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.pointers, self.values = EliasFano.load(arrays, name + ".pointers"), EliasFano.load(arrays, name + ".values")

    @staticmethod
    def arrays(name: str, contexts: int, group: np.ndarray, value: np.ndarray) -> dict[str, np.ndarray]:
        pointers = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=contexts))])
        return EliasFano.of(pointers).arrays(name + ".pointers") | EliasFano.of(_monotone(group, value)).arrays(name + ".values")

    def find(self, context: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions (-1: not there), and where each context's range begins."""
        # each pair once, in order: neighbours in the files are then asked for one after the other
        n = len(context)
        place, word = n.bit_length(), int(value.max(initial=0)).bit_length()
        if int(context.max(initial=0)).bit_length() + word + place < 64:  # pair and place in one number sort fastest
            packed = np.sort(context << (word + place) | value << place | np.arange(n))
            where, pairs = packed & ((1 << place) - 1), packed >> place
        else:
            where = np.lexsort((value, context))
            word, pairs = 32, (context << 32 | value)[where]
        new = np.concatenate([[True], pairs[1:] != pairs[:-1]])[:n]
        of, pairs = np.cumsum(new) - 1, pairs[new]
        at, start = self._find(pairs >> word, pairs & ((1 << word) - 1))
        out, begin = np.empty(n, np.int64), np.empty(n, np.int64)
        out[where], begin[where] = at[of], start[of]
        return out, begin

    def _find(self, context: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``context`` and, within one, ``value`` ascend."""
        out = np.full(len(context), -1, np.int64)
        if not len(context):
            return out, out
        new = np.concatenate([[True], context[1:] != context[:-1]])
        of = np.cumsum(new) - 1
        begin, end = (x.astype(np.int64) for x in self.pointers.access_two(context[new]))
        base = np.zeros(len(begin), np.uint64)
        wanted = value.astype(np.uint64) + np.uint64(1)
        # a short range is read from its begin on; the value before it is where the range starts from
        size = end - begin
        short = (size <= _SHORT) & (begin > 0)
        few = np.flatnonzero(short & (size > 0))
        if len(few):
            base[few], row = self.values.following(begin[few] - 1, size[few], _SHORT)
            number = np.zeros(len(begin), np.int64)
            number[few] = np.arange(len(few))
            mine = np.flatnonzero((short & (size > 0))[of])
            hit = row[number[of[mine]]] == (wanted[mine] + base[of[mine]])[:, None]
            found = np.flatnonzero(hit.any(1))
            out[mine[found]] = begin[of[mine[found]]] + hit[found].argmax(1)
        # in a long one the successor is searched
        later = np.flatnonzero(~short & (begin > 0))
        base[later] = self.values.access(begin[later] - 1)
        mine = np.flatnonzero((~short & (size > 0))[of])
        at, same = self.values.lookup(wanted[mine] + base[of[mine]])
        same &= at < end[of[mine]]
        out[mine[same]] = at[same]
        return out, begin[of]


@dataclass
class NgramModel:
    """Where the trie's files lie and how they are split; tasks open them themselves."""

    place: str
    seed: int = 0
    tokens: int = 0
    vocabulary: int = 0
    bits: int = 0
    buckets: list[int] = field(default_factory=list)  # upper bits of the hashes that have a file
    first: list[int] = field(default_factory=list)  # the first id of each
    # ranges of pairs of words: where each begins. A text's start is the id after all. A word that begins many pairs has several ranges.
    first_of: list[int] = field(default_factory=lambda: [0])
    second_of: list[int] = field(default_factory=lambda: [0])
    earlier: list[int] = field(default_factory=lambda: [0])  # successors of its first word that lie in ranges before

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1)))

    def hashes(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The 64-bit hashes of words, and others that tell words of one hash apart."""
        both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w, self.seed) for w in distinct.cast(pa.binary()).to_pylist()]), ">u8").reshape(-1, 2)
        return both[:, 1].astype(np.uint64), both[:, 0].astype(np.uint64)

    def ids(self, words: pa.Array) -> np.ndarray:
        """Ids of words, -1: unknown."""
        hashes, checks = self.hashes(words)
        out = np.full(len(hashes), -1, np.int64)
        bucket = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        place = np.full(1 << self.bits, -1)
        place[self.buckets] = np.arange(len(self.buckets))
        for k, mine in _each(place[bucket]):
            uri = f"{self.place}/1-{self.buckets[k]}"
            file, at = cached(uri), cached(uri, _hashes).find(hashes[mine])
            same = np.flatnonzero(at >= 0)
            same = same[file["check"][at[same]] == (checks[mine[same]] >> np.uint64(32)).astype(np.uint32)]
            out[mine[same]] = at[same] + self.first[k]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        file = np.searchsorted(self.first, ids, side="right") - 1
        for k in np.unique(file[ids >= 0]).tolist():
            mine = np.flatnonzero((file == k) & (ids >= 0))
            out[mine] = cached(f"{self.place}/1-{self.buckets[k]}")["count"][ids[mine] - self.first[k]]
        return out

    def shard(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The range of each pair, -1 where the first word is unknown; any that has the first word where the second is unknown."""
        begin = np.array(self.first_of) << 32 | np.array(self.second_of)
        return np.where(first >= 0, np.searchsorted(begin, np.maximum(first, 0) << 32 | np.maximum(second, 0), side="right") - 1, -1)

    def shard_of_place(self, first: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range that holds the successor at a place among all of a word's, and its place there."""
        begin = np.array(self.first_of) << 32 | np.array(self.earlier)
        shard = np.searchsorted(begin, first << 32 | place, side="right") - 1
        return shard, place - np.where(np.array(self.first_of)[shard] == first, np.array(self.earlier)[shard], 0)

    def width(self, shard: int) -> int:
        """First words of a range."""
        if shard + 1 == len(self.first_of):
            return self.vocabulary + 1 - self.first_of[shard]
        return self.first_of[shard + 1] - self.first_of[shard] + (self.second_of[shard + 1] > 0)

    def level(self, level: int, shard: int) -> dict[str, np.ndarray]:
        return cached(f"{self.place}/{level}-{shard}")

    def pairs(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node of each pair in its range's level 2 (-1: none), and its place among the first word's successors."""
        node, place = np.full(len(first), -1, np.int64), np.zeros(len(first), np.int64)
        for s, mine in _each(np.where(second >= 0, self.shard(first, second), -1)):
            at, begin = _successors(self.place, 2, s).find(first[mine] - self.first_of[s], second[mine])
            node[mine], place[mine] = at, at - begin
            if self.earlier[s]:
                place[mine] += np.where(first[mine] == self.first_of[s], self.earlier[s], 0)
        return node, place


def _packed(ascending: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Keys as differences, and counts; bytes of like weight lie together and are compressed."""
    out = []
    for a in (np.diff(ascending, prepend=0), n):
        planes = a.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
        out.append(len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True))
    return out[0], out[1]


def _unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps, n = (np.frombuffer(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True), np.uint8).reshape(8, -1).T.copy().view("<i8").reshape(-1) for x in (keys, counts))
    return np.cumsum(gaps), n


def _each(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each number from 0 on that occurs, and where."""
    if len(shard):
        small = shard.astype(np.int16) if shard.max() < 1 << 15 else shard
        order = np.argsort(small, kind="stable")
        there = shard[order]
        cut = np.flatnonzero(np.concatenate([[True], there[1:] != there[:-1]])).tolist()
        for b, e in zip(cut, [*cut[1:], len(there)], strict=True):
            if there[b] >= 0:
                yield int(there[b]), order[b:e]


def _next(arrays: dict[str, np.ndarray]) -> Successors:
    return Successors(arrays, "next")


def _hashes(arrays: dict[str, np.ndarray]) -> EliasFano:
    return EliasFano.load(arrays, "hashes")


def _successors(place: str, level: int, shard: int) -> Successors:
    return cached(f"{place}/{level}-{shard}", _next)


def _vocabulary(train: DataFrame, place: str, range_tokens: int) -> NgramModel:
    """Counts all words of the training part and writes level 1; deals pairs of words out to ranges of about ``range_tokens`` tokens."""
    spark = train.sparkSession
    for seed in range(_SEEDS):
        model = NgramModel(place, seed)

        def run(parts: Iterator[pa.RecordBatch], model: NgramModel = model) -> Iterator[dict]:
            for part in parts:
                distinct, code, counts = words(part.column("text"), lower=True)
                hashes, checks = model.hashes(pa.concat_arrays([distinct, _END]))
                yield {"hash": hashes.view(np.int64), "check": checks.view(np.int64), "n": np.append(np.bincount(code, minlength=len(distinct)), len(counts))}

        rows = over_chunks(train, run, "hash long, check long, n long")
        counted = rows.groupBy("hash").agg(F.sum("n").alias("n"), F.min("check").alias("c"), F.max("check").alias("d"))
        counted.write.parquet(f"{place}/words{seed}")
        counted = spark.read.parquet(f"{place}/words{seed}")
        total = counted.agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n"), F.count_if(F.col("c") != F.col("d")).alias("clash")).first()
        if not total.clash:
            break
        remove(f"{place}/words{seed}")  # two words share a hash: another seed
    else:
        raise RuntimeError(f"with each of {_SEEDS} seeds two words of the training part share a 64-bit hash")
    model.vocabulary, model.tokens = total.v, total.n or 0
    model.bits = bits = max(0, (total.v // 400_000).bit_length())
    bucket = F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long")
    the_end = model.hashes(_END)[0][0]

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = [p for p in parts if p.num_rows]
        if not held:
            return
        hashes, n, where, checks = (np.concatenate([p.column(c).to_numpy() for p in held]) for c in ("hash", "n", "bucket", "c"))
        order = np.argsort(hashes.view(np.uint64))
        hashes, n, where, checks = hashes.view(np.uint64)[order], n[order], where[order], (checks.view(np.uint64)[order] >> np.uint64(32)).astype(np.uint32)
        for b in np.unique(where).tolist():
            mine = where == b
            put_arrays(f"{place}/1-{b}", count=n[mine], check=checks[mine], **EliasFano.of(hashes[mine]).arrays("hashes"))
            end = np.flatnonzero(hashes[mine] == the_end)
            if len(end):  # one end a text
                yield {"bucket": [-1], "words": [0], "tokens": [int(n[mine][end[0]])]}
            own = np.flatnonzero(n[mine] > range_tokens // 4)
            cut = np.unique(np.concatenate([own, own + 1, np.linspace(0, mine.sum(), min(256, int(mine.sum())) + 1).astype(np.int64)]))
            for begin, stop in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                yield {"bucket": [b], "words": [stop - begin], "tokens": [int(n[mine][begin:stop].sum())]}

    # rows at the driver: at most 256 for 400,000 words, and two for each word with many tokens
    pieces = over_chunks(counted.select("hash", "n", "c", bucket.alias("bucket")).repartition("bucket"), write, "bucket long, words long, tokens long", limit=0).collect()
    remove(f"{place}/words{model.seed}")
    starts = sum(r.tokens for r in pieces if r.bucket < 0)
    pieces = sorted((r for r in pieces if r.bucket >= 0), key=lambda r: r.bucket)  # sorted() is stable, so a file's pieces stay in order
    words_before, tokens_before = (np.cumsum([0, *(r[c] for r in pieces)]) for c in ("words", "tokens"))
    for r, first in zip(pieces, words_before.tolist(), strict=False):
        if not model.buckets or model.buckets[-1] != r.bucket:
            model.buckets.append(r.bucket)
            model.first.append(first)
    ranges_, size = [(0, 0)], 0
    for first, n_words, tokens in [*((f, r.words, r.tokens) for f, r in zip(words_before.tolist(), pieces, strict=False)), (model.vocabulary, 1, starts)]:
        if size and size + tokens > range_tokens:
            ranges_.append((first, 0))
            size = 0
        size += tokens
        parts = -(-tokens // range_tokens) if n_words == 1 else 1
        # a word that begins many pairs: ranges of second words with about as many tokens each
        seconds = np.interp(np.arange(1, parts) * model.tokens / parts, tokens_before, words_before).astype(np.int64)
        ranges_ += [(first, x) for x in np.unique(seconds).tolist() if x > 0]
    model.first_of, model.second_of = map(list, zip(*ranges_, strict=True))
    model.earlier = [0] * len(ranges_)
    return model


def _encoded(docs: DataFrame, model: NgramModel) -> DataFrame:
    """Every text as ids (-1: unknown) with its end, and its base score."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in parts:
            distinct, code, n = words(part.column("text"), lower=True)
            known = model.ids(pa.concat_arrays([distinct, _END]))
            score = model.unigram(model.counts(known))
            at = np.insert(code, np.cumsum(n), len(known) - 1)
            stream = known.astype("<i4" if model.vocabulary < 2**31 - 2 else "<i8")[at]
            n = n + 1
            ends = np.cumsum(n)
            data = np.concatenate([[0], ends]) * stream.itemsize
            yield {
                "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": n, "n_known": np.add.reduceat(stream >= 0, ends - n, dtype=np.int64),
                "base_score": np.add.reduceat(score[at], ends - n), "ids": pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(data), pa.py_buffer(stream)]).cast(pa.binary()),
            }

    return over_chunks(docs, run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, ids binary")


def _streams(batches: Iterator[pa.RecordBatch], model: NgramModel) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of texts as ids: all ids, for each the one before (the start's id at a text's begin), and where texts begin."""
    for part in chunks(batches, _TOKENS, "ids"):
        ids = string_bytes(part.column("ids"))[0].view("<i4" if model.vocabulary < 2**31 - 2 else "<i8").astype(np.int64)
        n = part.column("n_tokens").to_numpy()
        begin = np.cumsum(n) - n
        before = np.concatenate([[0], ids[:-1]])
        before[begin] = model.vocabulary
        yield part, ids, before, begin


def _second(begin: np.ndarray, nodes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each id the node of the pair that ends before it, and that pair's first word."""
    node, first = np.concatenate([[-1], nodes[:-1]]), np.concatenate([[-1], before[:-1]])
    node[begin] = -1
    return node, first


def _counted(rows: DataFrame, model: NgramModel, level: int) -> DataFrame:
    """Counted n-grams of the training part in blobs: shard, ascending keys, counts. A key is context << 32 | word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> dict:
            nonlocal held, size
            packed = [(s, *_packed(*_all_merged(held.pop(s)))) for s in sorted(held)]
            size = 0
            return {"shard": [s for s, _, _ in packed], "keys": [k for _, k, _ in packed], "counts": [c for _, _, c in packed]}

        for _, ids, before, begin in _streams(batches, model):
            if level == 2:
                shard, key = model.shard(before, ids), before << 32 | ids
            else:
                nodes, place = model.pairs(before, ids)
                node, first = _second(begin, nodes, before)
                both = np.flatnonzero((node >= 0) & (nodes >= 0))
                shard, key = model.shard(first[both], before[both]), node[both] << 32 | place[both]
            for s, mine in _each(shard):
                sorted_ = np.sort(key[mine])
                new = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
                # the first word of a pair within its range
                held.setdefault(s, []).append((sorted_[new] - ((model.first_of[s] << 32) if level == 2 else 0), np.diff(np.append(new, len(sorted_)))))
                size += len(new)
            if size >= 3_000_000:
                yield flush()
        if size:
            yield flush()

    return over_chunks(rows.where("not held_out").select("ids", "n_tokens"), run, "shard int, keys binary, counts binary", limit=0)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(key, kind="stable")  # both are sorted, so this merges
    key, n = key[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[new], np.add.reduceat(n, new)


def _all_merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return runs[0] if len(runs) == 1 else _merged(*(tuple(np.concatenate(x) for x in zip(*runs, strict=True)), (np.zeros(0, np.int64), np.zeros(0, np.int64))))


def _joined(blobs: DataFrame, work) -> DataFrame:
    """Calls ``work`` with each shard's distinct keys and counts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for part in parts:
            for s, k, c in zip(*(part.column(n).to_pylist() for n in ("shard", "keys", "counts")), strict=True):
                mine = held.setdefault(s, [])
                mine.append(_unpacked(k, c))
                while len(mine) > 1 and len(mine[-2][0]) < 2 * len(mine[-1][0]):  # like sizes merge, so few lie there
                    mine[-2:] = [_merged(*mine[-2:])]
        for s in sorted(held):
            mine = held.pop(s)
            while len(mine) > 1:
                mine[-2:] = [_merged(*mine[-2:])]
            key, n = mine.pop()
            # of the contexts at the edges, which other ranges may have too: occurrences and kinds
            edge = [{"context": c, "n": int(n[b:e].sum()), "kinds": e - b} for c in {int(key[0] >> 32), int(key[-1] >> 32)} for b, e in [np.searchsorted(key, [c << 32, (c + 1) << 32]).tolist()]]
            yield {"shard": [s], "once": [int((n == 1).sum())], "twice": [int((n == 2).sum())], "edge": [edge]}
            work(s, key, n)

    return over_chunks(blobs.repartition("shard"), run, "shard int, once long, twice long, edge array<struct<context: long, n: long, kinds: long>>", limit=0)


def _discount(rows: list) -> float:
    once, twice = sum(r.once for r in rows), sum(r.twice for r in rows)
    return min(0.95, max(0.3, once / max(1, once + 2 * twice)))


def fit(docs: DataFrame, folds: int = 10, place: str | None = None, range_tokens: int = 2_000_000) -> tuple[NgramModel, DataFrame]:
    """Learns from rows whose crc32(doc_id) mod ``folds`` isn't 0. Returns the model and all texts as ids.
    ``range_tokens``: about so many tokens' pairs and triples are one task's; it changes nothing else."""
    spark = docs.sparkSession
    place = place or shared_dir(spark)
    docs = keyed_text(docs).withColumn("held_out", remainder("doc_id", folds) == 0)
    model = _vocabulary(docs.where("not held_out"), place, range_tokens)
    release(spark)
    _encoded(docs, model).write.option("compression", "zstd").parquet(f"{place}/ids")
    rows = spark.read.parquet(f"{place}/ids")

    def put_counts(uri: str, key: np.ndarray, n: np.ndarray, **more: np.ndarray) -> None:
        put_arrays(uri, **dict(zip(("key", "n"), (np.frombuffer(x, np.uint8) for x in _packed(key, n)), strict=True)), **more)

    def get_counts(uri: str) -> dict[str, np.ndarray]:
        raw = get_arrays(uri)
        return raw | dict(zip(("key", "n"), _unpacked(raw["key"].tobytes(), raw["n"].tobytes()), strict=True))

    def pairs(shard: int, key: np.ndarray, n: np.ndarray) -> None:
        context = key >> 32
        total = np.bincount(context, n, model.width(shard)).astype(np.int64)
        put_counts(f"{place}/counts2/{shard}", key, n, total=total)

    counted = _joined(_counted(rows, model, 2), pairs).collect()
    release(spark)
    discount = _discount(counted)
    split = {f for f, x in zip(model.first_of, model.second_of, strict=True) if x}
    edges = {r.shard: r.edge for r in counted}
    wide: dict[int, tuple[int, int]] = {}  # occurrences and kinds of pairs that begin with a word of several ranges
    for s, (f, x) in enumerate(zip(model.first_of, model.second_of, strict=True)):
        model.earlier[s] = wide.get(f, (0, 0))[1] if x else 0
        for e in edges.get(s, ()):
            if (word := e.context + f) in split:
                n, kinds = wide.get(word, (0, 0))
                wide[word] = n + e.n, kinds + e.kinds
    n_ranges = len(model.first_of)
    shards = spark.createDataFrame([(s,) for s in range(n_ranges)], "shard int").repartition(n_ranges, "shard")

    def level2(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in parts:
            for s in part.column("shard").to_pylist():
                try:
                    raw = get_counts(f"{place}/counts2/{s}")
                except FileNotFoundError:  # no text has a word of this range
                    raw = {"key": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "total": np.zeros(model.width(s), np.int64)}
                context, word, n, total = raw["key"] >> 32, raw["key"] & 0xFFFFFFFF, raw["n"], raw["total"].copy()
                shared = {c: wide[c + model.first_of[s]] for c in {0, len(total) - 1} if c + model.first_of[s] in wide}
                for c, (all_, _) in shared.items():
                    total[c] = all_
                share = (n - discount) / np.maximum(1, total[context])
                rest = 1 - np.bincount(context, share, len(total))
                for c, (all_, kinds) in shared.items():
                    rest[c] = discount * kinds / all_
                p = share + rest[context] * 10 ** model.unigram(model.counts(word))
                put_arrays(f"{place}/2-{s}", p=_quantised(np.log10(p)), rest=_quantised(np.log10(np.clip(rest, 1e-9, 1))), n=n.astype(np.uint32 if n.max(initial=0) < 1 << 32 else np.int64), **Successors.arrays("next", len(total), context, word))
                yield {"shard": [s]}

    over_chunks(shards, level2, "shard int", limit=0).collect()
    remove(f"{place}/counts2")

    def triples(shard: int, key: np.ndarray, n: np.ndarray) -> None:
        put_counts(f"{place}/counts3/{shard}", key, n)

    discount3 = _discount(_joined(_counted(rows, model, 3), triples).collect())
    release(spark)

    def level3(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in parts:
            for s in part.column("shard").to_pylist():
                try:
                    raw = get_counts(f"{place}/counts3/{s}")
                except FileNotFoundError:
                    raw = {"key": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)}
                node, place3, n = raw["key"] >> 32, raw["key"] & 0xFFFFFFFF, raw["n"]
                two, next2 = model.level(2, s), _successors(place, 2, s)
                total = two["n"].astype(np.int64)
                share = (n - discount3) / np.maximum(1, total[node])
                rest = np.clip(1 - np.bincount(node, share, len(total)), 1e-9, 1)
                # the second word of a node, and the probability of the third after it
                begin = next2.pointers.all().astype(np.int64)
                context = np.searchsorted(begin, node, side="right") - 1
                base = np.where(begin[context] > 0, next2.values.access(np.maximum(begin[context] - 1, 0)), np.uint64(0)) if len(node) else np.zeros(0, np.uint64)
                second = (next2.values.access(node) - base - np.uint64(1)).astype(np.int64)
                lower = np.zeros(len(node))
                where, inner = model.shard_of_place(second, place3)
                for t, mine in _each(where):
                    start = _successors(place, 2, t).pointers.access(second[mine] - model.first_of[t]).astype(np.int64)
                    lower[mine] = _value(model.level(2, t)["p"][start + inner[mine]])
                p = share + rest[node] * 10**lower
                put_arrays(f"{place}/3-{s}", p=_quantised(np.log10(np.minimum(p, 1))), rest=_quantised(np.log10(rest)), **Successors.arrays("next", len(total), node, place3))
                yield {"shard": [s]}

    over_chunks(shards, level3, "shard int", limit=0).collect()
    remove(f"{place}/counts3")
    return model, rows


def token_scores(model: NgramModel, ids: np.ndarray, before: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """log10 probability of every id after the two before it."""
    nodes, place = model.pairs(before, ids)
    node, first = _second(begin, nodes, before)
    score, open_ = np.zeros(len(ids)), np.ones(len(ids), bool)
    # the longest context that has the word decides; on the way there, what it leaves to shorter ones
    for s, mine in _each(np.where(node >= 0, model.shard(first, before), -1)):
        three = model.level(3, s)
        at = np.full(len(mine), -1, np.int64)
        pair = np.flatnonzero(nodes[mine] >= 0)
        at[pair], _ = _successors(model.place, 3, s).find(node[mine[pair]], place[mine[pair]])
        score[mine] = _value(np.where(at >= 0, three["p"][at] if len(three["p"]) else 0, three["rest"][node[mine]]))
        open_[mine[at >= 0]] = False
    for s, mine in _each(np.where(open_, model.shard(before, ids), -1)):
        two = model.level(2, s)
        seen = nodes[mine] >= 0
        score[mine[seen]] += _value(two["p"][nodes[mine[seen]]])
        score[mine[~seen]] += _value(two["rest"][before[mine[~seen]] - model.first_of[s]])
    rest = np.flatnonzero(open_ & (nodes < 0))
    score[rest] += model.unigram(model.counts(ids[rest]))
    return score


def score(model: NgramModel, rows: DataFrame) -> DataFrame:
    """``rows``: what ``fit`` returned. Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part, ids, before, begin in _streams(batches, model):
            kept = {c: part.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")}
            yield kept | {"train_tokens": [model.tokens] * part.num_rows, "score": np.add.reduceat(token_scores(model, ids, before, begin), begin)}

    return over_chunks(rows, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", limit=0)


