"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xC2B2AE3D27D4EB4F)
M3 = np.uint64(0x165667B19E3779F9)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays."""
    x = x ^ (x >> np.uint64(31))
    x = x * M1
    x = x ^ (x >> np.uint64(29))
    x = x * M2
    return x ^ (x >> np.uint64(32))


class WordHashes:
    """64-bit hashes of words, kept in a bounded table between documents."""

    def __init__(self, most: int = 400_000):
        self.most, self.table = most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        t = self.table
        got = [t.get(w) for w in words]
        if None in got:
            digest = xxhash.xxh3_64_intdigest
            if len(t) > self.most:
                t.clear()
            for i, h in enumerate(got):
                if h is None:
                    w = words[i]
                    got[i] = t[w] = digest(w)
        return np.array(got, np.uint64)


_KEPT: dict[object, object] = {}


def only(key: object, make: Callable[[], object]) -> object:
    """What a worker keeps between batches and tasks. There is one such thing at a time: another key drops it."""
    if key not in _KEPT:
        drop_kept()
        _KEPT[key] = make()
    return _KEPT[key]


def drop_kept() -> None:
    """What a worker kept goes: for tasks that keep something else, or nothing."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()  # an encoder and its table refer to each other, and nothing else collects them soon: 58 MB each time


def release() -> None:
    """Give memory that is free back to the system; workers stay alive between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidy(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of a group that gives memory back when it is done."""

    def run(t: pa.Table) -> pa.Table:
        try:
            return f(t)
        finally:
            release()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a plain local path."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_file(uri: str, parts: Iterable[bytes]) -> int:
    """Write a file under a name of this attempt, then move it into place; return its size."""
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    size, part_name = 0, f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part_name) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    fs.move(part_name, path)
    return size


def drop_folder(uri: str) -> None:
    """Delete a folder of the shared root that nothing reads any more."""
    fs, path = open_fs(uri)
    try:
        fs.delete_dir(path)
    except OSError:
        pass  # it is gone, or the store keeps it; either way results don't depend on it


def read_file(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(f.size() - offset if length is None else length, offset)


def map_file(uri: str) -> tuple[np.ndarray, bool]:
    """The bytes of a shared file, and whether they are memory-mapped: those of other stores are read."""
    fs, path = open_fs(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        size = fs.get_file_info(path).size
        return (np.asarray(np.memmap(path, np.uint8, "r")) if size else np.empty(0, np.uint8)), True
    return np.frombuffer(read_file(uri), np.uint8), False


class FileBytes:
    """A shared file as an array whose slices are read when they are asked for."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> np.ndarray:
        a, b, _ = part.indices(self.size)
        return np.frombuffer(self.file.read_at(b - a, a), np.uint8)


def blocks(batches: Iterable[pa.RecordBatch], text_at: int = 1, most: int = 32 << 20) -> Iterator[pa.Table]:
    """Batches joined into tables of about ``most`` bytes, so that memory stays bounded for any partition."""
    held, size, count = [], 0, 0
    release()
    for b in batches:
        step = max(1, int(b.num_rows * most / max(1, b.nbytes)))
        for k in range(0, b.num_rows, step):
            part = b.slice(k, step)
            held.append(part)
            size += part.nbytes
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size, count = [], 0, count + 1
                if count % 4 == 0:
                    release()
        del b, part
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    release()


def doc_texts(df: DataFrame) -> DataFrame:
    """Only the two columns that the operators read, whatever else the input holds."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated runs [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
