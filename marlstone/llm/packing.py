"""Best-fit decreasing packing of token pieces into sequences of a fixed length.

Pieces of one length are alike, and so are open sequences with the same free space, so the best-fit
decreasing of *all* pieces runs on a histogram of lengths: a segment tree over the free spaces 1 to
``capacity`` finds the tightest open sequences in logarithmic time, and a whole batch of equal pieces
goes there at once. The plan is what placing piece by piece would give; its size depends on
``capacity`` alone. Each piece's rank among its equals then says where it lies, in parallel.

Defined cases: a null or empty text is its end token; rows with the same doc_id are packed each for
itself, those without one too; pieces as long as each other are placed by their task and their place
in it, open sequences with as much space by when they were opened; a very long text is a chunk of its
own; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import CHUNK_BYTES, keyed_text, over_chunks, shared_dir, task_number
from marlstone.llm.wordcache import word_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Tightest:
    """Segment tree over free spaces: which is the smallest, of at least a given size, that some sequence has?"""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.width)

    def set(self, space: int, is_open: bool) -> None:
        i = space + self.width
        self.open[i] = is_open
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def at_least(self, space: int) -> int | None:
        i = space + self.width
        if self.open[i]:
            return space
        while i > 1:  # up to the first right sibling with something open
            if not i & 1 and self.open[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.width:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.width


@dataclass
class Plan:
    """Pieces of ``length`` with ranks from ``rank``: ``each`` in a sequence, one after the other, from ``offset`` on."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self._key(self.length, self.rank), self._key(length, rank), side="right") - 1
        behind = rank - self.rank[at]
        return self.sequence[at] + behind // self.each[at], self.offset[at] + behind % self.each[at] * length

    @staticmethod
    def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return (length.astype(np.int64) << 46) | rank


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """``counts``: how many pieces there are of each length from 1 to ``capacity``."""
    tree, spaces, runs, made = Tightest(capacity), defaultdict(deque), [], 0

    def opened(space: int, first: int, n: int) -> None:
        if space and n:
            spaces[space].append((first, n))
            tree.set(space, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            space = tree.at_least(length)
            if space is None:
                space, each = capacity, capacity // length
                first, n = made, -(-left // each)
                made += n
            else:
                first, n = spaces[space].popleft()
                each = space // length
            put = min(left, n * each)
            full, rest = divmod(put, each)
            runs.append((length, rank, first, each, capacity - space))
            if space in spaces and not spaces[space]:
                tree.set(space, False)
            opened(space - each * length, first, full)
            opened(space - rest * length, first + full, int(rest > 0))
            opened(space, first + full + (rest > 0), n - full - (rest > 0))
            rank, left = rank + put, left - put
    a = np.array(sorted(runs) or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    return Plan(*a.T, sequences=made)


def cut(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of ``n`` ids: the document, its piece's number, start and length. Only the first is shorter."""
    pieces = np.maximum(1, -(-n // capacity))
    row = np.repeat(np.arange(len(n)), pieces)
    number = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    head = n - (pieces - 1) * capacity
    start = np.where(number == 0, 0, head[row] + (number - 1) * capacity)
    return row, number, start, np.where(number == 0, head[row], capacity)


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of every document, each with its task's number and its rank there among pieces as long."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder, seen, task = word_encoder(path), np.zeros(capacity + 1, np.int64), task_number()
        for part in parts:
            ids, n = encoder.encode(part.column("text"))
            first = np.cumsum(n) - n
            stream = np.insert(ids.astype("<u4"), first + n, end_id)
            n = n + 1
            row, number, start, length = cut(n, capacity)
            begin = (np.cumsum(n) - n)[row] + start
            data = memoryview(stream)
            crc = np.fromiter((zlib.crc32(data[b:e]) for b, e in zip(begin.tolist(), (begin + length).tolist(), strict=True)), np.int64, len(row))
            order = np.argsort(length, kind="stable")
            group = length[order]
            fresh = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            within = np.arange(len(group)) - np.repeat(fresh, np.diff(np.append(fresh, len(group))))
            rank = np.empty(len(group), np.int64)
            rank[order] = seen[group] + within
            seen += np.bincount(length, minlength=capacity + 1)
            yield {"doc_id": part.column("doc_id").take(pa.array(row)), "piece": number.astype(np.int32), "start": start, "length": length, "ids_crc32": crc, "task": np.full(len(row), task), "rank": rank}

    return over_chunks(keyed_text(docs), run, PIECES + ", task long, rank long", CHUNK_BYTES // 2)


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int | None = None) -> DataFrame:
    """Packs all documents into as few sequences of ``capacity`` ids as best-fit decreasing finds.

    ``path`` names a byte-level tokenizer file; each document ends with ``end_id`` (2). Returns a row
    per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    place = shared_dir(spark)
    token_pieces(docs, path, capacity, 2 if end_id is None else end_id).write.parquet(f"{place}/pieces")
    pieces = spark.read.parquet(f"{place}/pieces")
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    # at most ``capacity`` rows come to the driver
    plan = best_fit_decreasing({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranked = pieces.join(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), ["task", "length"])
    schema = PIECES + ", sequence_id long, offset long"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in parts:
            sequence, offset = plan.place(part.column("length").to_numpy(), part.column("rank").to_numpy() + part.column("before").to_numpy())
            yield {n: part.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": sequence, "offset": offset}

    return over_chunks(ranked, run, schema, limit=0)


