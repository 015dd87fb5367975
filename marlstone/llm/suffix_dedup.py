"""Removal of repeated 200-byte strings by a distributed merge sort of suffixes.

Every 200-byte window has an anchor: the 100-byte string in it with the least rolling hash (the first,
if there are several). Windows in a row with one anchor are a segment: the suffix that begins at the
anchor and the bytes before it. Equal windows have equal anchors at equal places, so only segments
whose anchor's hash occurs twice in the corpus can hold a repeat.

Their suffixes are sorted: each task sorts its own, joins equal ones, and exchanges front-coded runs
(the length of the prefix shared with the one before, and the rest), cut into ranges of the sort's
key, more of them the more there is to sort. A loser tree merges the runs of a range; each of its nodes remembers how long a prefix its suffix shares with the last one put out,
so known prefixes are never compared again, and the merge yields the common prefixes of neighbours.
With the shared bytes before the anchors, these say which windows of a segment occur elsewhere. The
answer is kept by a segment's content, not its place, and every document looks its segments up and
compares the bytes of each hit: a passage that a third of all documents share costs no more than one
that two share. Segments of an anchor that occurs very often, with ever other surroundings, are cut
into shorter ones whose common part is longer and spreads them over ranges.

Defined cases: a null or empty text has no bytes and keeps the hash of nothing; repeated rows count
as occurrences of each other; an empty table gives no rows; columns other than doc_id and text are
not read; a very long text is cut into slices for the search that overlap by a window less a byte.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cached, filesystem, keyed_text, mix, over_chunks, partitions, put, put_arrays, ranges, remove, shared_dir, string_bytes, task_number

_B = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_SLICE = 2 << 20
_TABLE = mix(np.arange(1, 257, dtype=np.uint64))
_POSITION = 24


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_B, -1, 1 << 64)
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, np.uint64))]) for b in (_B, inverse))


class Segments:
    """The segments of texts of ``raw`` bytes: first and last window, anchor, the hashes of anchor and content."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, length: int):
        k = length // 2
        self.length, n = length, len(raw)
        none = np.zeros(0, np.int64)
        self.first = self.last = self.anchor = none
        self.key = self.content = none.astype(np.uint64)
        if n < length:
            return
        power, inverse = _powers(1 << max(22, n.bit_length()))
        total = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[raw] * power[:n])])
        self._hash = lambda b, e: mix((total[e] - total[b]) * inverse[b] + (e - b).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        x = mix((total[k:] - total[: n - k + 1]) * inverse[: n - k + 1])
        low = np.uint64((1 << _POSITION) - 1)
        least = (x & ~low) | np.arange(len(x), dtype=np.uint64)
        width, done = length - k + 1, 1  # strings of k bytes in a window
        while 2 * done <= width:
            least = np.minimum(least[:-done], least[done:])
            done *= 2
        if done < width:
            least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
        doc_end = np.repeat(starts[1:], np.diff(starts))[: len(least)]
        window = np.flatnonzero(np.arange(len(least)) + length <= doc_end)
        if not len(window):
            return
        value = least[window]
        new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (window[1:] != window[:-1] + 1)]))
        self.first, self.last = window[new], window[np.append(new[1:], len(window)) - 1]
        self.anchor = (value[new] & low).astype(np.int64)
        self.key = mix(x[self.anchor])  # least hashes are small ones; mixed, they spread evenly over ranges
        self._name()

    def _name(self) -> None:
        d = (self.anchor - self.first).astype(np.uint64)
        self.content = mix(self._hash(self.first, self.last + self.length) + d)

    def take(self, rows: np.ndarray) -> None:
        self.first, self.last, self.anchor, self.key, self.content = (x[rows] for x in (self.first, self.last, self.anchor, self.key, self.content))

    def split(self, hot: SortedFiles | None, width: int = 16) -> None:
        """Cuts segments of hot anchors into some of at most ``width`` windows; the key is what all windows at such distances from the anchor share."""
        found = [r for r, _, _ in hot.find(self.key)] if hot and len(self.key) else []
        if not found:
            return
        width = min(width, self.length)
        rows = np.concatenate(found)
        least, most = (self.anchor[rows] - self.last[rows]) // width, (self.anchor[rows] - self.first[rows]) // width
        step, of = ranges(least, most - least + 1) * width, np.repeat(rows, most - least + 1)
        anchor = self.anchor[of]
        begin = anchor - step
        key = mix(self._hash(begin, begin + self.length - width + 1) + step.astype(np.uint64) + np.uint64(1))
        first, last = np.maximum(self.first[of], begin - width + 1), np.minimum(self.last[of], begin)
        rest = np.delete(np.arange(len(self.key)), rows)
        self.first, self.last, self.anchor, self.key = (np.concatenate([a[rest], b]) for a, b in ((self.first, first), (self.last, last), (self.anchor, anchor), (self.key, key)))
        self._name()


def _slices(part: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """A chunk's bytes and text starts; a long text alone comes in slices that overlap by one window less a byte."""
    raw, starts = string_bytes(part.column("text"))
    if len(raw) <= 2 * _SLICE:
        yield raw, starts, 0
        return
    for b, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        for at in range(b, max(b + 1, e - length + 1), _SLICE):
            piece = raw[at : min(e, at + _SLICE + length - 1)]
            yield piece, np.array([0, len(piece)]), at


class SortedFiles:
    """Arrays sorted by a 64-bit key, in files by its upper ``bits``; read memory-mapped."""

    def __init__(self, place: str, bits: int):
        self.place, self.bits = place, bits

    @staticmethod
    def write(rows: DataFrame, place: str, columns: list[str], data: str | None = None, each: int = 500_000) -> SortedFiles:
        """``rows``: key, ``columns`` of small integers, and ``data``, a column of bytes. A file has about ``each`` rows."""
        rows.write.option("parquet.block.size", 8 << 20).parquet(f"{place}/rows")
        rows = rows.sparkSession.read.parquet(f"{place}/rows")
        bits = max(4, (rows.count() // each).bit_length())  # several files at least, so no task writes all
        bucket = F.shiftrightunsigned("key", 64 - bits)

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            def file(b: int, held: list[pa.RecordBatch]) -> None:
                key, *rest = (np.concatenate([p.column(c).to_numpy() for p in held]) for c in ("key", *columns))
                order = np.argsort(key.view(np.uint64), kind="stable")
                more = {}
                if data:
                    taken = pa.concat_arrays([p.column(data).cast(pa.large_binary()) for p in held]).take(pa.array(order))
                    more["bytes"], more["ends"] = string_bytes(taken)
                put_arrays(f"{place}/{b}.sorted", key=key.view(np.uint64)[order], **{c: r[order].astype(np.int16) for c, r in zip(columns, rest, strict=True)}, **more)

            now, held = None, []
            for part in parts:
                where = part.column("bucket").to_numpy()
                cut = np.flatnonzero(np.diff(where)) + 1
                for begin, end in zip([0, *cut.tolist()], [*cut.tolist(), len(where)], strict=True):
                    if begin < end:
                        if held and where[begin] != now:
                            file(now, held)
                            yield {"bucket": [now]}
                            held = []
                        now = int(where[begin])
                        held.append(part.slice(begin, end - begin))
            if held:
                file(now, held)
                yield {"bucket": [now]}

        over_chunks(rows.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket"), run, "bucket long", limit=0).count()
        remove(f"{place}/rows")
        return SortedFiles(place, bits)

    def find(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
        """For each file: which of the keys it holds, where their first entries are, its arrays."""
        bucket = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order])) + 1
        for rows in np.split(order, cut):
            if len(rows) and (file := _open(self.place, int(bucket[rows[0]]))):
                at = np.searchsorted(file["key"], keys[rows])
                hit = file["key"][np.minimum(at, len(file["key"]) - 1)] == keys[rows]
                yield rows[hit], at[hit], file


def _open(place: str, bucket: int) -> dict[str, np.ndarray] | None:
    try:
        return cached(f"{place}/{bucket}.sorted")
    except FileNotFoundError:  # no key has these upper bits
        return None


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    n = min(len(a), len(b))
    while known < n and a[known : known + 32] == b[known : known + 32]:
        known += 32
    while known < n and a[known] == b[known]:
        known += 1
    return min(known, n)


Entry = tuple[bytes, bytes, int]  # anchor's hash and suffix; the bytes before it, backwards; how often


def front_coded(entries: list[Entry]) -> bytes:
    """A sorted run: shared prefix with the entry before, the rest of the suffix, the bytes before it, the count."""
    out, last = [], b""
    for suffix, before, n in entries:
        h = common_prefix(last, suffix)
        rest = suffix[h:]
        out += [h.to_bytes(2, "little"), len(rest).to_bytes(2, "little"), rest, len(before).to_bytes(2, "little"), before, n.to_bytes(5, "little")]
        last = suffix
    return b"".join(out)


def decoded(run: bytes) -> Iterator[tuple[int, Entry]]:
    at, last, number = 0, b"", int.from_bytes
    while at < len(run):
        h, n = number(run[at : at + 2], "little"), number(run[at + 2 : at + 4], "little")
        last = last[:h] + run[at + 4 : at + 4 + n]
        at += 4 + n
        m = number(run[at : at + 2], "little")
        yield h, (last, run[at + 2 : at + 2 + m], number(run[at + 2 + m : at + 7 + m], "little"))
        at += 7 + m


def merged(runs: list[bytes]) -> Iterator[tuple[int, Entry]]:
    """All entries in order, each with the length of the prefix that it shares with the one before.

    A tree of losers over the runs. ``shared[r]`` is what run r's head has in common with the last
    winner that passed it; of two heads the one that shares more with it is smaller, and only heads
    that share equally much are compared, from there on.
    """
    size = 1 << max(0, len(runs) - 1).bit_length()
    sources = [decoded(r) for r in runs]
    heads: list[Entry | None] = [None] * size
    shared = [0] * size
    for r, s in enumerate(sources):
        shared[r], heads[r] = next(s, (0, None))
    tree = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        s, t = x[0], y[0]
        h = common_prefix(s, t, shared[a])
        if s[h : h + 1] <= t[h : h + 1]:
            shared[b] = h
            return a, b
        shared[a] = h
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if size > 1 else 0
    while heads[winner] is not None:
        yield shared[winner], heads[winner]
        shared[winner], heads[winner] = next(sources[winner], (0, None))
        node = (winner + size) >> 1
        while node:
            winner, tree[node] = play(winner, tree[node])
            node >>= 1


def repeats(group: list[tuple[int, Entry]], length: int) -> Iterator[tuple[Entry, int, int]]:
    """Of the entries of one anchor, in order: which windows occur elsewhere, as spans of bytes before the anchor.

    The common prefixes of neighbours make a tree of suffixes. It is closed from its leaves to its
    root; a node has the bytes before all entries below it, sorted, so the two neighbours of an entry
    there share the most with it. Of two nodes that join, the smaller one's entries go into the other's.
    """
    spans: list[list[tuple[int, int]]] = [[] for _ in group]
    stack: list[tuple[int, list[tuple[bytes, int]]]] = []

    def close(until: int) -> None:
        while len(stack) > 1 and stack[-1][0] >= until:
            h, a = stack.pop()
            left, b = stack.pop()
            if len(a) < len(b):
                a, b = b, a
            for entry in b:
                at = bisect_left(a, entry)
                for other in a[max(0, at - 1) : at + 1]:
                    d = common_prefix(entry[0], other[0])
                    if d >= length - h:  # the windows with length - h to d bytes before the anchor are in both
                        spans[entry[1]].append((length - h, d))
                        spans[other[1]].append((length - h, d))
                a.insert(at, entry)
            stack.append((left, a))

    for i, (h, (_, before, _)) in enumerate(group):
        close(h - 8)
        stack.append((h - 8, [(before, i)]))
    close(-8)
    for (_, entry), found in zip(group, spans, strict=True):
        suffix, before, n = entry
        low, high, at = length - len(suffix) + 8, len(before), None
        if n > 1:
            yield entry, low, high
            continue
        for b, e in sorted((max(low, b), e) for b, e in found if max(low, b) <= e):
            if at and b <= at[1] + 1:
                at[1] = max(at[1], e)
            else:
                if at:
                    yield entry, *at
                at = [b, e]
        if at:
            yield entry, *at


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """Hashes of anchors that several segments have, and how many."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in parts:
            for raw, starts, _ in _slices(part, length):
                key, n = np.unique(Segments(raw, starts, length).key, return_counts=True)
                yield {"key": key.view(np.int64), "n": n}

    rows = over_chunks(docs, run, "key long, n long", _SLICE)
    return rows.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def _runs(docs: DataFrame, repeated: SortedFiles, hot: SortedFiles | None, buckets: int, length: int, place: str, held_bytes: int = 24 << 20) -> DataFrame:
    """Writes the runs of all ranges that a task has at a time to one file; a row says where a range's run lies."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[dict[tuple[bytes, bytes], int]] = [{} for _ in range(buckets)]
        size = 0

        def flush() -> dict:
            nonlocal held, size
            uri, out, packed, at = f"{place}/{task_number():07d}-{uuid.uuid4().hex}.runs", [], [], 0
            for b in range(buckets):
                if held[b]:
                    run = front_coded(sorted((s, p, n) for (s, p), n in held[b].items()))
                    held[b] = {}
                    packed.append(pa.compress(run, "zstd", asbytes=True))
                    out.append((b, at, len(packed[-1]), len(run)))
                    at += len(packed[-1])
            size = 0
            put(uri, lambda f: [f.write(x) for x in packed])
            return {"uri": [uri] * len(out)} | dict(zip(("bucket", "at", "packed", "size"), map(list, zip(*out, strict=True)), strict=True))

        for part in parts:
            for raw, starts, _ in _slices(part, length):
                s = Segments(raw, starts, length)
                rows = [r for r, _, _ in repeated.find(s.key)]
                if not rows:
                    continue
                s.take(np.concatenate(rows))
                s.split(hot)
                data, keys = raw.tobytes(), s.key.astype(">u8").tobytes()
                where = ((s.key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).tolist()  # ranges of the key, in order
                for k, (b, first, anchor, last) in enumerate(zip(where, s.first.tolist(), s.anchor.tolist(), s.last.tolist(), strict=True)):
                    entry = keys[8 * k : 8 * k + 8] + data[anchor : last + length], data[first:anchor][::-1]
                    n = held[b].get(entry, 0)
                    held[b][entry] = n + 1
                    if not n:
                        size += len(entry[0]) + len(entry[1]) + 150
                if size >= held_bytes:
                    yield flush()
        if size:
            yield flush()

    return over_chunks(docs, run, "bucket int, uri string, at long, packed long, size long", _SLICE)


def _read_run(uri: str, at: int, packed: int, size: int) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_file(path) as f:
        return pa.decompress(f.read_at(packed, at), size, "zstd", asbytes=True)


def _found(runs: DataFrame, length: int) -> DataFrame:
    """Merges the runs of each bucket; a row for each span of repeated windows: the segment's content, least and most bytes before the anchor, bytes before it in all."""
    table = np.frombuffer(_TABLE.tobytes(), np.uint64)
    power, _ = _powers(1 << max(12, (2 * length).bit_length()))

    def content(entries: list[Entry]) -> np.ndarray:
        out = np.zeros(len(entries), np.uint64)
        for i, (suffix, before, _) in enumerate(entries):
            raw = np.frombuffer(before[::-1] + suffix[8:], np.uint8)
            out[i] = (table[raw] * power[: len(raw)]).sum()
        size = np.array([len(s) - 8 + len(p) for s, p, _ in entries], np.uint64)
        return mix(mix(out + size * np.uint64(0xD6E8FEB86659FD93)) + np.array([len(p) for _, p, _ in entries], np.uint64))

    def of_bucket(runs: list[bytes]) -> Iterator[dict]:
        group: list[tuple[int, Entry]] = []
        out: list[tuple[Entry, int, int]] = []

        def rows() -> dict:
            return {
                "key": content([e for e, _, _ in out]).view(np.int64), "low": [x for _, x, _ in out], "high": [x for _, _, x in out],
                "before": [len(p) for (_, p, _), _, _ in out], "bytes": [p[::-1] + s[8:] for (s, p, _), _, _ in out],
            }

        for h, entry in merged(runs):
            if group and entry[:2] == group[-1][1][:2]:  # the same segment from another run
                last_h, last = group[-1]
                group[-1] = last_h, (*last[:2], last[2] + entry[2])
                continue
            if h < 8:
                out += repeats(_by_suffix(group), length)
                group = []
            group.append((h, entry))
            if len(out) > 20_000:
                yield rows()
                out = []
        out += repeats(_by_suffix(group), length)
        if out:
            yield rows()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bucket, held = None, []
        for part in parts:
            for b, *where in zip(*(part.column(c).to_pylist() for c in ("bucket", "uri", "at", "packed", "size")), strict=True):
                if b != bucket and held:
                    yield from of_bucket([_read_run(*w) for w in held])
                    held = []
                bucket = b
                held.append(where)
        if held:
            yield from of_bucket([_read_run(*w) for w in held])

    # a row is little, the run that it names is not: a stated number of partitions isn't merged by bytes
    return over_chunks(runs.repartition(partitions(runs.sparkSession), "bucket").sortWithinPartitions("bucket"), run, "key long, low int, high int, before int, bytes binary", limit=0)


def _by_suffix(group: list[tuple[int, Entry]]) -> list[tuple[int, Entry]]:
    """Joins entries of equal suffix and equal bytes before; runs put out equal suffixes in any order of these."""
    if len(group) < 2:
        return group
    out: list[tuple[int, Entry]] = []
    begin = 0
    for i in range(1, len(group) + 1):
        if i == len(group) or group[i][1][0] != group[begin][1][0]:
            counts: dict[bytes, int] = {}
            for _, (_, before, n) in group[begin:i]:
                counts[before] = counts.get(before, 0) + n
            suffix, h = group[begin][1][0], group[begin][0]
            for k, (before, n) in enumerate(sorted(counts.items())):
                out.append((len(suffix) if k else h, (suffix, before, n)))
            begin = i
    return out


def _removed(raw: np.ndarray, starts: np.ndarray, found: SortedFiles, hot: SortedFiles | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans of bytes to remove; they may overlap. What a hash finds counts only if the bytes are the same."""
    s = Segments(raw, starts, length)
    s.split(hot)
    data, begin, end = memoryview(raw), [], []
    for rows, at, file in found.find(s.content):
        stored = memoryview(file["bytes"])
        while len(rows):
            first, last = s.first[rows], s.last[rows] + length
            places = zip(first.tolist(), last.tolist(), file["ends"][at].tolist(), file["ends"][at + 1].tolist(), strict=True)
            same = np.fromiter((data[b:e] == stored[x:y] for b, e, x, y in places), bool, len(rows)) & (s.anchor[rows] - first == file["before"][at])
            begin.append(s.anchor[rows[same]] - file["high"][at[same]])
            end.append(s.anchor[rows[same]] - file["low"][at[same]] + length)
            at = at + 1
            more = (at < len(file["key"])) & (file["key"][np.minimum(at, len(file["key"]) - 1)] == s.content[rows])
            rows, at = rows[more], at[more]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *begin]), np.concatenate([none, *end])


def repeated_bytes(docs: DataFrame, length: int = 200, often: int = 200_000, range_bytes: int = 64 << 20) -> DataFrame:
    """Removes every byte that a ``length``-byte string covers which also starts anywhere else.

    Returns per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256. Segments of an anchor that
    occurs more than ``often`` times are cut shorter; a range to sort has about ``range_bytes``. Both
    change nothing but speed.
    """
    spark = docs.sparkSession
    place, docs = shared_dir(spark), keyed_text(docs)
    _anchors(docs, length).write.parquet(f"{place}/counts")
    counts = spark.read.parquet(f"{place}/counts")
    total = counts.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    repeated = SortedFiles.write(counts.select("key"), f"{place}/anchors", [])
    hot = SortedFiles.write(counts.where(F.col("n") > often).select("key"), f"{place}/hot", []) if (total.most or 0) > often else None
    buckets = max(partitions(spark), (total.n or 0) * 2 * length // range_bytes)
    _runs(docs, repeated, hot, buckets, length, f"{place}/runs").write.parquet(f"{place}/list")
    found = SortedFiles.write(_found(spark.read.parquet(f"{place}/list"), length), f"{place}/found", ["low", "high", "before"], "bytes", 100_000)
    remove(f"{place}/runs")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in parts:
            raw, starts = string_bytes(part.column("text"))
            edge = np.zeros(len(raw) + 1, np.int32)
            for piece, inner, at in _slices(part, length):
                begin, end = _removed(piece, inner, found, hot, length)
                np.add.at(edge, begin + at, 1)
                np.add.at(edge, end + at, -1)
            gone = np.cumsum(edge)[:-1] > 0
            first = gone & ~np.concatenate([[False], gone[:-1]])[: len(gone)]
            head = starts[:-1][starts[:-1] < len(raw)]
            first[head] = gone[head]
            data, rows = raw[~gone].tobytes(), np.concatenate([[0], np.cumsum(gone)])
            removed, spans = rows[starts[1:]] - rows[starts[:-1]], np.concatenate([[0], np.cumsum(first)])
            size = np.diff(starts)
            ends = np.cumsum(size - removed)
            yield {
                "doc_id": part.column("doc_id"), "n_bytes": size, "n_removed": removed, "n_spans": spans[starts[1:]] - spans[starts[:-1]],
                "kept_sha256": [hashlib.sha256(data[b:e]).hexdigest() for b, e in zip((ends - size + removed).tolist(), ends.tolist(), strict=True)],
            }

    return over_chunks(docs, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", _SLICE)
