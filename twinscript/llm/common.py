"""What the operators of this folder share: inputs, folds, hashes, files in the shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a missing text being empty."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def free(columns: list[str], *names: str) -> list[str]:
    """The names with as many underscores in front as it takes to be none of the columns', in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(doc_id: Column | str, folds: int = 5) -> Column:
    """``crc32(doc_id as text) mod folds``; a missing id counts as the empty text."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def tasks(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def task_name() -> str:
    """Names a task's output: by partition and attempt, so that attempts never share a file."""
    ctx = TaskContext.get()
    return f"{ctx.partitionId():06d}-{ctx.taskAttemptId()}" if ctx else "000000-0"


def partition_id() -> int:
    ctx = TaskContext.get()
    return ctx.partitionId() if ctx else 0


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser over unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = x.astype(U64) + U64(((seed + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def release() -> None:
    """Return freed memory to the system: workers live on after a task, beside the executor's own heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 4 << 20,
           rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The batches again, in pieces whose ``column`` holds about ``limit`` bytes, a row at least.

    Between batches a worker gives back the memory it does not use any more.
    """
    for b in batches:
        release()
        if not b.num_rows:
            continue
        c = b.column(b.schema.get_field_index(column))
        wide = pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type)
        ends = np.frombuffer(c.buffers()[1], dtype=np.int64 if wide else np.int32)[c.offset:c.offset + b.num_rows + 1]
        at = 0
        while at < b.num_rows:
            stop = int(np.searchsorted(ends, int(ends[at]) + limit, side="right")) - 1
            stop = min(max(stop, at + 1), at + rows, b.num_rows)
            yield b.slice(at, stop - at)
            at = stop
    release()


def compact(column: pa.Array) -> pa.Array:
    """The strings with 64-bit offsets that start at 0: some kernels take the offsets of a slice wrong."""
    empty = pa.array([], pa.large_string())
    return pa.concat_arrays([column.cast(pa.large_string()), empty, empty])


def file_system(path: str):
    """(file system, path in it) of a path below the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_file(folder: str, name: str, parts: Iterable[bytes]) -> str:
    """Write a file under an attempt's own name, then move it to ``name``; returns its path.

    A repeated or speculative attempt writes the same bytes, so whichever moves last does no harm.
    """
    system, base = file_system(folder)
    system.create_dir(base, recursive=True)
    tmp = f"{base}/.{name}-{task_name()}"
    with system.open_output_stream(tmp) as out:
        for part in parts:
            out.write(part)
    system.move(tmp, f"{base}/{name}")
    return f"{folder}/{name}"


def read_file(path: str) -> pa.NativeFile:
    """Open for random access; a local file is memory-mapped, any other is read in ranges."""
    system, inner = file_system(path)
    if system.type_name == "local":
        return pa.memory_map(inner, "r")
    return system.open_input_file(inner)


_COPIES: dict[str, object] = {}


def mapped(path: str):
    """The bytes of a file of the shared folder, memory-mapped; a worker copies a file that cannot be mapped once."""
    system, inner = file_system(path)
    if system.type_name == "local":
        with pa.memory_map(inner, "r") as f:
            return f.read_buffer()
    if path not in _COPIES:
        import tempfile

        with tempfile.TemporaryFile() as copy, system.open_input_stream(inner) as source:
            while block := source.read(1 << 22):
                copy.write(block)
            copy.flush()
            import mmap

            _COPIES[path] = mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_READ)
    return _COPIES[path]
