"""What the operators share: the shared folder, files in it, Arrow helpers.

Workers and driver share only the folder that ``spark.checkpoint.dir`` names, so every file that one
task leaves for another goes there, is written under a temporary name and moved into place. A task
that runs twice writes the same bytes to the same name.
"""

from __future__ import annotations

import gc
import io
import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}
#: Bytes of text that an operator handles at a time inside a task.
CHUNK_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_dir.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="marlstone-"))
    return f"{base.rstrip('/')}/marlstone-{uuid.uuid4().hex[:12]}"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def put(uri: str, write: Callable[[io.IOBase], None]) -> None:
    """Writes a file so that readers see all of it or nothing."""
    store, path = filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with store.open_output_stream(part) as out:
        write(out)
    store.move(part, path)


def get(uri: str) -> np.ndarray:
    """The bytes of a file: memory-mapped in a mounted folder, else read."""
    store, path = filesystem(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.asarray(np.memmap(path, dtype=np.uint8, mode="r")) if os.path.getsize(path) else np.zeros(0, np.uint8)  # slices of a plain array cost less
    with store.open_input_stream(path) as f:
        return np.frombuffer(f.read(), np.uint8)


def remove(*uris: str) -> None:
    for uri in uris:
        store, path = filesystem(uri)
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)


def put_arrays(uri: str, **arrays: np.ndarray) -> None:
    """A file of named arrays, each on a 64-byte boundary, that ``get_arrays`` maps without reading."""

    def write(out) -> None:
        head, at = [], 0
        for name, a in arrays.items():
            head.append((name, a.dtype.str, a.size, at))
            at += (a.nbytes + 63) // 64 * 64
        text = repr(head).encode()
        text += b" " * ((-len(text) - 8) % 64)
        out.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes())
            out.write(b"\0" * (-a.nbytes % 64))

    put(uri, write)


def get_arrays(uri: str) -> dict[str, np.ndarray]:
    import ast

    raw = get(uri)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    return {name: raw[8 + n + at : 8 + n + at + np.dtype(kind).itemsize * size].view(kind) for name, kind, size, at in ast.literal_eval(raw[8 : 8 + n].tobytes().decode())}


_cached: OrderedDict[tuple[str, object], tuple[object, int]] = OrderedDict()


def cached(uri: str, build: Callable[[dict[str, np.ndarray]], object] = dict, most: int = 256 << 20) -> object:
    """What ``build`` makes of a file's arrays, kept for later calls in this worker.

    Mapped files cost no memory of the worker's; of files that had to be read, because the shared
    folder isn't mounted, the ones used last stay, up to ``most`` bytes.
    """
    if (uri, build) in _cached:
        _cached.move_to_end((uri, build))
        return _cached[uri, build][0]
    arrays = get_arrays(uri)
    size = 0 if isinstance(filesystem(uri)[0], fs.LocalFileSystem) else sum(a.nbytes for a in arrays.values())
    _cached[uri, build] = build(arrays), size
    total = sum(n for _, n in _cached.values()) if size else 0
    for key in list(_cached)[:-1]:
        if total <= most and len(_cached) <= 8192:
            break
        total -= _cached.pop(key)[1]
    return _cached[uri, build][0]


def forget(prefix: str) -> None:
    """Lets the files go whose names begin so."""
    for key in [k for k in _cached if k[0].startswith(prefix)]:
        del _cached[key]


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are done: its cleaner waits until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    """The number of partitions for steps whose work isn't told by their bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns are never read; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``limit`` bytes of ``column``; a longer value is a piece of its own."""
    waiting: list[pa.RecordBatch] = []
    held = 0

    def joined() -> pa.RecordBatch:
        return waiting[0] if len(waiting) == 1 else pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + limit - held, side="right")))
            if waiting and end == at + 1 and sizes[at] - before > limit - held:
                yield joined()
                waiting, held = [], 0
                continue
            waiting.append(batch.slice(at, end - at))
            held += int(sizes[end - 1] - before)
            at = end
            if held >= limit:
                yield joined()
                waiting, held = [], 0
    if waiting:
        yield joined()


def per_chunk(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """Maps chunks of text to columns. ``make`` builds the state of a task; the function it returns gives the columns of a chunk."""
    return over_chunks(df, lambda it: filter(None, map(make(), it)), schema, limit)


def over_chunks(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str, limit: int = CHUNK_BYTES) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    names = to_arrow_schema(_parse_datatype_string(schema))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(chunks(batches, limit) if limit else batches):
            yield from out_batches(columns, names)

    return df.mapInArrow(task, schema)


def out_batches(columns: dict, schema: pa.Schema, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def task_number() -> int:
    """The number of the partition that this task handles."""
    context = TaskContext.get()
    return context.partitionId() if context else 0


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column, and where each value starts (one more at the end)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of range(start, start + length)."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def filled_text(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch of any columns, null as empty."""
    return pc.fill_null(batch.column("text").cast(pa.string()), "")


def keep_rows(docs: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], np.ndarray]]) -> DataFrame:
    """The rows, with all their columns, for which the function that ``make`` builds in the task says True."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        for batch in chunks(batches):
            yield batch.filter(pa.array(test(batch)))

    return docs.mapInArrow(task, docs.schema)


def keep_one(docs: DataFrame, chosen: DataFrame, **keys: Column) -> DataFrame:
    """Of ``docs``, with all columns, one row for each row of ``chosen``.

    ``chosen``: doc_id, the names of ``keys``, and ``copies``, how many rows of ``docs`` have these
    values. ``keys``: how they are computed from a document. Rows alike in all of them are told apart
    by the smallest text, in a partial aggregation, so a hot value meets in no task.
    """
    mark = uuid.uuid4().hex[:8]
    names = {k: f"{k}_{mark}" for k in keys}
    keyed = docs.withColumns({names[k]: c for k, c in keys.items()})
    wanted = chosen.select(F.col("doc_id").alias(f"id_{mark}"), *(F.col(k).alias(f"{n}_") for k, n in names.items()), F.col("copies").alias(f"copies_{mark}"))

    def rows(chosen: DataFrame) -> DataFrame:
        on = keyed["doc_id"].cast("long").eqNullSafe(chosen[f"id_{mark}"])
        for n in names.values():
            on &= keyed[n] == chosen[f"{n}_"]
        return keyed.join(chosen, on, "left_semi")

    single = rows(wanted.where(f"copies_{mark} = 1")).drop(*names.values())
    several = wanted.where(f"copies_{mark} > 1")
    if several.isEmpty():
        return single
    whole = F.min_by(F.struct(*docs.columns), F.coalesce(F.col("text"), F.lit(""))).alias("row")
    return single.unionByName(rows(several).groupBy("doc_id", *names.values()).agg(whole).select("row.*"))


def remainder(column: str, n: int):
    """crc32 of a column as text, modulo n; null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words between ASCII white space: the distinct ones, the number of each word in turn, and words per text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    there = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not there.all():
        gone = np.concatenate([[0], np.cumsum(~there)])
        ends = np.cumsum(counts)
        counts = counts - (gone[ends] - gone[ends - counts])
        flat = flat.filter(pa.array(there))
    numbered = flat.dictionary_encode()
    return numbered.dictionary, numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts
