"""Token-id files with Elias-Fano document boundaries.

A file holds the ids of its documents one after the other (two bytes an id where the vocabulary
allows it), the boundaries between documents and the ascending doc_ids, both as Elias-Fano
sequences: document i starts at ``boundaries.access(i)``, and the document that holds an id is found
by successor search. Files are memory-mapped where they are read. Their names ascend with doc_id.

Defined cases: a null or empty text is its end token; equal doc_ids lie side by side in the order of
their texts; a null doc_id counts as the smallest value and comes back as null; a very long text is a
chunk and may be a file of its own; an empty table gives no rows; columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import CHUNK_BYTES, get_arrays, keyed_text, over_chunks, partitions, put_arrays, shared_dir, task_number
from marlstone.llm.eliasfano import EliasFano
from marlstone.llm.wordcache import word_encoder

#: doc_ids are stored as unsigned distances from the smallest one.
_LEAST = np.iinfo(np.int64).min
FILES = "uri string, task long, number long, n_docs long, n_ids long"


class TokenFile:
    """Reads a file of ``write_tokens``."""

    def __init__(self, uri: str):
        a = get_arrays(uri)
        self.ids, self.has_id = a["ids"], a["has_id"]
        self.boundaries, self._docs = EliasFano.load(a, "boundaries"), EliasFano.load(a, "docs")
        self._first = int(a["first"][0])

    def __len__(self) -> int:
        return self._docs.n

    def doc_ids(self) -> np.ndarray:
        return self._docs.all().view(np.int64) + self._first

    def document(self, i: int) -> np.ndarray:
        begin, end = self.boundaries.access(np.array([i, i + 1])).astype(np.int64)
        return self.ids[begin:end]

    def document_at(self, position: int) -> int:
        """The document that holds the id at ``position``."""
        return int(self.boundaries.successor(np.array([position + 1], np.uint64))[0]) - 1

    def find(self, doc_id: int) -> int:
        """The first document with this doc_id, -1 if there is none."""
        return int(self._docs.find(np.array([doc_id - self._first], np.int64).view(np.uint64))[0])


def write_tokens(uri: str, doc_ids: np.ndarray, has_id: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
    ends = np.concatenate([[0], np.cumsum(counts)])
    first = int(doc_ids[0]) if len(doc_ids) else 0
    put_arrays(uri, ids=ids, has_id=has_id.astype(np.uint8), first=np.array([first], np.int64), **EliasFano.of(ends).arrays("boundaries"), **EliasFano.of((doc_ids - first).view(np.uint64)).arrays("docs"))


def write_files(docs: DataFrame, path: str, place: str, end_id: int = 2, file_ids: int = 1 << 24) -> DataFrame:
    """Writes the files of all documents in ascending order of doc_id and returns one row per file: uri, task, number, n_docs, n_ids.

    A range partition of doc_id is one task's; it starts a new file when one has ``file_ids`` ids, so
    no task holds more than that. Files ascend by task and number.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder, task, held, size, number = word_encoder(path), task_number(), [], 0, 0
        wide = encoder.tokenizer.get_vocab_size() > 1 << 16 or end_id >= 1 << 16

        def flush() -> dict:
            nonlocal held, size, number
            doc, has, ids, n = (np.concatenate(x) for x in zip(*held, strict=True))
            uri = f"{place}/{task:07d}-{number:05d}.tok"
            write_tokens(uri, doc, has, ids, n)
            held, size, number = [], 0, number + 1
            return {"uri": [uri], "task": [task], "number": [number], "n_docs": [len(n)], "n_ids": [len(ids)]}

        for part in parts:
            ids, n = encoder.encode(part.column("text"))
            stream = np.insert(ids.astype("<u4" if wide else "<u2", copy=False), np.cumsum(n), end_id)
            column = part.column("doc_id")
            held.append((column.fill_null(_LEAST).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False), stream, n + 1))
            size += len(stream)
            if size >= file_ids:
                yield flush()
        if held:
            yield flush()

    ordered = keyed_text(docs).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return over_chunks(ordered, run, FILES, CHUNK_BYTES // 2)


def token_files(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Encodes all documents, writes their files and reads them back.

    Returns per document, from the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (over 32-bit little-endian ids). The driver gets one sum for each range of doc_ids.
    """
    spark = docs.sparkSession
    place = shared_dir(spark)
    write_files(docs, path, place, end_id).write.parquet(f"{place}/list")
    files = spark.read.schema(FILES).parquet(f"{place}/list")
    sums = sorted(files.groupBy("task").agg(F.sum("n_ids").alias("n")).collect())
    before = spark.createDataFrame([(r.task, int(n)) for r, n in zip(sums, np.cumsum([0, *(r.n for r in sums)]), strict=False)], "task long, earlier long")
    in_task = Window.partitionBy("task").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("inner", F.coalesce(F.sum("n_ids").over(in_task), F.lit(0))).join(before, "task")
    # a file is much work for a short row: a stated number of partitions isn't merged by bytes
    table = placed.select("uri", (F.col("earlier") + F.col("inner")).alias("before")).repartition(max(partitions(spark), len(sums)), "uri")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in parts:
            for uri, offset in zip(part.column("uri").to_pylist(), part.column("before").to_pylist(), strict=True):
                file = TokenFile(uri)
                ends = file.boundaries.access(np.arange(len(file) + 1)).astype(np.int64)
                crc = np.fromiter((zlib.crc32(file.ids[b:e].astype("<u4")) for b, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)), np.int64, len(file))
                yield {"doc_id": pa.array(file.doc_ids(), mask=file.has_id == 0), "start": ends[:-1] + offset, "n_tokens": np.diff(ends), "ids_crc32": crc}

    return over_chunks(table, run, "doc_id long, start long, n_tokens long, ids_crc32 long", limit=0)
