"""Exact deduplication with a log-structured merge index of digests.

Every task puts its rows into an index: a memtable of texts takes them, compares the bytes of every
hit with the text it holds, and flushes, when full, a run of digests, sorted. Compaction merges the
runs of all tasks by digest and keeps the row that stays. Each run that a merge makes has a Bloom
filter: an arriving run is probed against those of the runs that lie there, and only digests that one
of them may hold are searched in it. A digest that occurs in several runs is a hit between them: the
texts that stand for those runs are read again, found by a bitmap filter of bounded size, and compared
byte by byte, so a digest that two texts share splits into two groups. A run has one entry for all
copies that its memtable saw, so no group of copies, however large, comes to one task.

Defined cases: a null text is empty, and all texts without a character that counts are one group;
rows with equal doc_ids are separate rows; a null doc_id loses ties; any long is a doc_id; an empty
table gives no rows; columns other than doc_id and text are not read; a text is never cut, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import keep_one, keyed_text, mix, over_chunks, ranges, shared_dir, string_bytes, task_number

WHITE = bytes([0x20, *range(0x09, 0x0E)])
RUNS = "is_entry int, entry long, key binary, sha256 binary, n long, chars long, doc long, unnamed boolean"


class Bloom:
    """A filter over digests: about ten bits and four probes for each."""

    def __init__(self, digests: np.ndarray):
        self.bits = np.zeros(max(64, 1 << int(10 * len(digests)).bit_length()) // 8, np.uint8)
        for at in self._probes(digests):
            np.bitwise_or.at(self.bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def _probes(self, digests: np.ndarray) -> list[np.ndarray]:
        raw = np.frombuffer(np.ascontiguousarray(digests).tobytes(), np.uint8).reshape(len(digests), digests.dtype.itemsize)
        seed = np.zeros((len(digests), 8), np.uint8)
        seed[:, : min(8, raw.shape[1])] = raw[:, :8]
        base = seed.view(np.uint64).reshape(-1)
        return [(mix(base + np.uint64(i)) % np.uint64(8 * len(self.bits))).astype(np.int64) for i in range(1, 5)]

    def may_hold(self, digests: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([self.bits[at >> 3] >> (at & 7) & 1 for at in self._probes(digests)]).astype(bool)


class LsmIndex:
    """Digest -> entries: rows counted, code points and doc_id of the row that stays, a number.

    ``add`` puts a text in; texts of one entry have equal bytes. Full memtables become sorted runs.
    ``ingest`` takes runs in and finds digests that an earlier one has: ``probes`` counts the digests
    that were asked of a filter, ``searches`` those that were then searched.
    """

    def __init__(self, digest_bytes: int = 32, memtable_bytes: int = 32 << 20):
        self.digest_bytes, self.limit = digest_bytes, memtable_bytes
        self.memtable: dict[bytes, list] = {}
        self.held = self.entries = self.probes = self.searches = 0
        self.runs: list[tuple[np.ndarray, Bloom]] = []
        self.kind = np.dtype([("digest", f"S{digest_bytes}"), ("n", "i8"), ("chars", "i8"), ("doc", "i8"), ("unnamed", "?"), ("entry", "i8")])
        self.repeated: list[np.ndarray] = []

    def add(self, digest: bytes, text: bytes, chars: int, doc: int | None) -> int:
        variants = self.memtable.setdefault(digest[: self.digest_bytes], [])
        rank = chars, doc is not None, -(doc or 0)
        for v in variants:
            if v[0] == text:  # the bytes of a hit are compared
                v[1] += 1
                v[2] = max(v[2], rank)
                return v[3]
        variants.append([text, 1, rank, self.entries])
        self.entries += 1
        self.held += len(text) + 200
        return self.entries - 1

    def full(self) -> bool:
        return self.held >= self.limit

    def flush(self) -> np.ndarray:
        """The memtable as a run, sorted by digest; it is empty then."""
        run = np.array([(d, n, chars, -less, not named, e) for d in sorted(self.memtable) for _, n, (chars, named, less), e in self.memtable[d]], self.kind)
        self.memtable, self.held = {}, 0
        return run

    def ingest(self, run: np.ndarray) -> None:
        """Takes a sorted run in; runs of like size merge at once, so there are few."""
        digest = run["digest"]
        self.repeated.append(digest[1:][digest[1:] == digest[:-1]])
        for old, bloom in self.runs:
            maybe = digest[bloom.may_hold(digest)]
            self.probes, self.searches = self.probes + len(run), self.searches + len(maybe)
            at = np.minimum(np.searchsorted(old["digest"], maybe), len(old) - 1)
            self.repeated.append(maybe[old["digest"][at] == maybe])
        while self.runs and len(run) * 2 >= len(self.runs[-1][0]):
            run = self._merged(self.runs.pop()[0], run)
        if len(run):
            self.runs.append((run, Bloom(run["digest"])))

    @staticmethod
    def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = np.concatenate([a, b])
        return both[np.argsort(both["digest"], kind="stable")]

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        """All runs as one, and how many entries each entry's digest has: more than 1 only for those found repeated."""
        run = np.zeros(0, self.kind)
        while self.runs:
            run = self._merged(run, self.runs.pop()[0])
        alike = np.ones(len(run), np.int64)
        found = np.unique(np.concatenate([np.zeros(0, f"S{self.digest_bytes}"), *self.repeated]))
        begin, end = (np.searchsorted(run["digest"], found, side) for side in ("left", "right"))
        alike[ranges(begin, end - begin)] = np.repeat(end - begin, end - begin)
        if len(run):
            self.runs = [(run, Bloom(run["digest"]))]
        return run, alike

    def find(self, digest: bytes) -> np.ndarray:
        """The entries of a digest in all runs; the filters spare most of the searches."""
        d = np.array([digest[: self.digest_bytes]], f"S{self.digest_bytes}")
        found = [run[slice(*(np.searchsorted(run["digest"], d[0], side) for side in ("left", "right")))] for run, bloom in self.runs if bloom.may_hold(d)[0]]
        return np.concatenate([np.zeros(0, self.kind), *found])


def normalised(column: pa.Array) -> list[bytes]:
    raw, starts = string_bytes(column)
    data = raw.tobytes()
    return [data[b:e].translate(None, WHITE) for b, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def _index(docs: DataFrame, digest_bytes: int, memtable_bytes: int) -> DataFrame:
    """A row for each document (its entry, digest and code points), and one for each entry of a run."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        index, task = LsmIndex(digest_bytes, memtable_bytes), task_number() << 36

        def entries() -> dict:
            r = index.flush()
            key = r["digest"].astype(f"S{digest_bytes}").tobytes()
            return {"is_entry": [1] * len(r), "entry": r["entry"] + task, "key": [key[i : i + digest_bytes] for i in range(0, len(key), digest_bytes)], "sha256": pa.nulls(len(r), pa.binary())} | {c: r[c].copy() for c in ("n", "chars", "doc", "unnamed")}

        for part in parts:
            texts = normalised(part.column("text"))
            sha = [hashlib.sha256(t).digest() for t in texts]
            chars = pc.utf8_length(part.column("text")).to_pylist()
            ids = part.column("doc_id")
            entry = [index.add(*row) for row in zip(sha, texts, chars, ids.to_pylist(), strict=True)]
            yield {"is_entry": [0] * len(sha), "entry": np.array(entry) + task, "key": pa.nulls(len(sha), pa.binary()), "sha256": sha, "n": [1] * len(sha), "chars": chars, "doc": ids.fill_null(0), "unnamed": ids.is_null()}
            if index.full():
                yield entries()
        if index.memtable:
            yield entries()

    return over_chunks(keyed_text(docs), run, RUNS)


def _compacted(entries: DataFrame, digest_bytes: int) -> DataFrame:
    """Merges all runs; adds to each entry how many its digest has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        index = LsmIndex(digest_bytes)
        for b in batches:
            r = np.zeros(b.num_rows, index.kind)
            r["digest"] = b.column("key").to_pylist()
            for name in ("n", "chars", "doc", "unnamed", "entry"):
                r[name] = b.column(name).to_numpy(zero_copy_only=False)
            index.ingest(r[np.argsort(r["digest"], kind="stable")])
        r, alike = index.compact()
        if len(r):
            key = r["digest"].tobytes()
            yield {"key": [key[i : i + digest_bytes] for i in range(0, len(key), digest_bytes)], "alike": alike} | {n: r[n].copy() for n in ("entry", "n", "chars", "doc", "unnamed")}

    return over_chunks(entries.repartition("key"), run, "key binary, entry long, n long, chars long, doc long, unnamed boolean, alike long", limit=0)


def _filter_bits(keys: DataFrame, n: int, most: int = 1 << 26) -> np.ndarray:
    """A bitmap of the hashed keys, 4 KB to 8 MB however many there are: more keys only let more rows pass."""
    bits = min(most, max(1 << 15, 1 << (16 * n).bit_length()))
    at = keys.select((F.pmod(F.xxhash64("doc"), F.lit(bits)) + 1).alias("at"))
    out = np.zeros(bits // 8, np.uint8)
    for row in at.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m")).collect():
        out[(row.b - 1) * 4096 : row.b * 4096] = np.frombuffer(row.m, np.uint8)
    return out


def _texts(docs: DataFrame, bits: np.ndarray, digest_bytes: int) -> DataFrame:
    """Normalised texts of the rows that the bitmap lets pass."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in parts:
            at = part.column("at").to_numpy()
            part = part.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))
            texts = normalised(part.column("text"))
            yield {"doc": part.column("doc_id").fill_null(0), "unnamed": part.column("doc_id").is_null(), "key": [hashlib.sha256(t).digest()[:digest_bytes] for t in texts], "bytes": texts}

    rows = keyed_text(docs).withColumn("at", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0).cast("long"))), F.lit(8 * len(bits))))
    return over_chunks(rows, run, "doc long, unnamed boolean, key binary, bytes binary")


def _grouped(docs: DataFrame, digest_bytes: int, memtable_bytes: int) -> DataFrame:
    """The rows of documents, with their group's size and the code points and doc_id of the row that stays."""
    spark = docs.sparkSession
    place = shared_dir(spark)
    _index(docs, digest_bytes, memtable_bytes).write.partitionBy("is_entry").parquet(f"{place}/runs")
    runs = spark.read.schema(RUNS).parquet(f"{place}/runs")
    _compacted(runs.where("is_entry = 1"), digest_bytes).write.parquet(f"{place}/index")
    index = spark.read.parquet(f"{place}/index")
    several = index.where("alike > 1")
    groups = index.where("alike = 1").select("entry", F.col("doc").alias("keep"), F.col("unnamed").alias("keep_unnamed"), F.col("chars").alias("keep_chars"), F.col("n").alias("size"))
    if many := several.count():
        found = _texts(docs, _filter_bits(several, many), digest_bytes)
        at = ["doc", "unnamed", "key"]
        found.join(several.select(*at), at, "left_semi").write.parquet(f"{place}/texts")
        texts = spark.read.parquet(f"{place}/texts")
        # the bytes decide; only where several texts share a digest are they needed again, to tell its entries apart
        of_key = texts.select("key", "bytes").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("texts"))
        of_key.write.parquet(f"{place}/variants")
        of_key = spark.read.parquet(f"{place}/variants")
        first = several.groupBy("key").agg(F.min("entry").alias("same")).join(of_key.where("texts = 1"), "key", "left_semi")
        alone = several.join(first, "key").select("entry", "same", "n", "chars", "doc", "unnamed")
        clash = texts.join(of_key.where("texts > 1"), "key", "left_semi").join(several.select(*at, "entry"), at).dropDuplicates(["entry"])
        same = clash.groupBy("key", "bytes").agg(F.min("entry").alias("same"))
        apart = clash.join(same, ["key", "bytes"]).select("entry", "same").join(several, "entry").select(*alone.columns)
        alone.unionByName(apart).write.parquet(f"{place}/members")
        members = spark.read.parquet(f"{place}/members")
        best = F.max(F.struct("chars", (~F.col("unnamed")).alias("named"), F.bitwise_not("doc").alias("less"))).alias("best")
        totals = members.groupBy("same").agg(F.sum("n").alias("size"), best)
        groups = groups.unionByName(members.join(totals, "same").select("entry", F.bitwise_not("best.less").alias("keep"), (~F.col("best.named")).alias("keep_unnamed"), F.col("best.chars").alias("keep_chars"), "size"))
    return runs.where("is_entry = 0").join(groups, "entry").withColumn("kept", (F.col("doc") == F.col("keep")) & (F.col("unnamed") == F.col("keep_unnamed")))


def exact_duplicates(docs: DataFrame, digest_bytes: int = 32, memtable_bytes: int = 32 << 20) -> DataFrame:
    """Groups documents whose texts are equal without ASCII white space.

    Returns per document: doc_id, keep_id (the row with the most code points, then the smallest
    doc_id), group_size, kept, text_sha256. Of rows that share the doc_id of the one that stays, all count as kept.
    """
    rows = _grouped(docs, digest_bytes, memtable_bytes)
    known = lambda c, gone: F.when(~F.col(gone), F.col(c))
    return rows.select(known("doc", "unnamed").alias("doc_id"), known("keep", "keep_unnamed").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


def deduplicated(docs: DataFrame, digest_bytes: int = 32, memtable_bytes: int = 32 << 20) -> DataFrame:
    """One row of each group, with all its columns; of rows alike in code points and doc_id that with the smallest text."""
    place = shared_dir(docs.sparkSession)
    rows = _grouped(docs, digest_bytes, memtable_bytes).where(F.col("kept") & (F.col("chars") == F.col("keep_chars")))
    chosen = rows.groupBy(F.when(~F.col("unnamed"), F.col("doc")).alias("doc_id"), "sha256", "chars").agg(F.count(F.lit(1)).alias("copies"))
    chosen.write.parquet(f"{place}/chosen")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sha256 = F.unhex(F.sha2(F.translate(text, WHITE.decode(), "").cast("binary"), 256))
    return keep_one(docs, docs.sparkSession.read.parquet(f"{place}/chosen"), sha256=sha256, chars=F.char_length(text).cast("long"))
