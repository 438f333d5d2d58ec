"""Token ids in binary files: independent zstandard frames with a trailing seek table and per-frame checksums.

A file holds whole documents in ascending order. Layout, all numbers little-endian:

* data frames: each an ordinary zstandard frame with the ids of some whole documents (about ``FRAME_IDS`` ids);
* a skippable frame (magic 0x184D2A50) with the document index: a zstandard frame over three arrays, doc_id (int64),
  whether it is null (uint8) and the number of ids (int64), in file order;
* a skippable frame (magic 0x184D2A5E) with the seek table of the zstandard seekable format: for each data frame its
  compressed and decompressed size and the low 32 bits of the XXH64 of its decompressed bytes, then the number of
  frames, a descriptor byte (0x80: checksums are present) and the magic 0x8F92EAB1.

Readers take the last nine bytes, then the tables, and decompress only frames that hold requested documents.
"""

from __future__ import annotations

import struct
import uuid
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm.common import FileBytes, blocks, doc_texts, write_file
from pagegrain.llm.tokens import crc_ids, encoder
from pagegrain.runtime import shared_folder, ship_package

#: Ids that fill a frame, bytes of text that a task encodes at a time, and that it gets in all.
FRAME_IDS, BLOCK, PART_BYTES = 1 << 16, 4 << 20, 128 << 20
INDEX_MAGIC, SEEK_MAGIC, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


class StoreWriter:
    """One file, part by part: ``add`` gives the frames that are full, ``end`` the last one and the tables.

    Only the frame at hand and the index (17 bytes a document) are held.
    """

    def __init__(self, level: int = 1, width: int = 2):
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.kind = np.dtype(f"<u{width}")
        self.table, self.held, self.size = [], [], 0
        self.ids, self.nulls, self.lens = array("q"), bytearray(), array("q")

    def add(self, doc_ids: list[int | None], ids: np.ndarray, borders: np.ndarray) -> Iterator[bytes]:
        """Whole documents: ids[borders[i] : borders[i + 1]] belong to doc_ids[i]."""
        self.ids.extend(d or 0 for d in doc_ids)
        self.nulls.extend(d is None for d in doc_ids)
        self.lens.extend(np.diff(borders).tolist())
        at = 0
        for i in range(1, len(borders)):
            if borders[i] - borders[at] + self.size >= FRAME_IDS or i == len(borders) - 1:
                self.held.append(ids[borders[at] : borders[i]].astype(self.kind).tobytes())
                self.size += int(borders[i] - borders[at])
                at = i
                if self.size >= FRAME_IDS:
                    yield self._close()

    def _close(self) -> bytes:
        raw = b"".join(self.held)
        frame = self.zstd.compress(raw)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0
        return frame

    def end(self) -> Iterator[bytes]:
        if self.size:
            yield self._close()
        index = np.array(self.ids, "<i8").tobytes() + bytes(self.nulls) + np.array(self.lens, "<i8").tobytes()
        index = struct.pack("<BQ", self.kind.itemsize, len(self.ids)) + self.zstd.compress(index)
        yield struct.pack("<II", INDEX_MAGIC, len(index)) + index
        seek = b"".join(struct.pack("<III", *row) for row in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEK_END)
        yield struct.pack("<II", SEEK_MAGIC, len(seek)) + seek


class StoreReader:
    """Random access to one file."""

    def __init__(self, data: bytes | np.ndarray | FileBytes):
        self.data = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
        n, flags, end = struct.unpack("<IBI", self.data[-9:].tobytes())
        if end != SEEK_END or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        seek = np.frombuffer(self.data[-9 - 12 * n : -9].tobytes(), "<u4").reshape(n, 3)
        magic, size = struct.unpack("<II", self.data[-17 - 12 * n : -9 - 12 * n].tobytes())
        if magic != SEEK_MAGIC or size != 12 * n + 9:
            raise ValueError("the seek table is damaged")
        self.sizes, self.sums = seek[:, :2].astype(np.int64), seek[:, 2]
        self.at = np.concatenate([[0], np.cumsum(self.sizes[:, 0])])
        where = int(self.at[-1])
        magic, size = struct.unpack("<II", self.data[where : where + 8].tobytes())
        if magic != INDEX_MAGIC:
            raise ValueError("the document index is missing")
        width, docs = struct.unpack("<BQ", self.data[where + 8 : where + 17].tobytes())
        self.kind = np.dtype(f"<u{width}")
        raw = zstandard.ZstdDecompressor().decompress(self.data[where + 17 : where + 8 + size].tobytes())
        self.doc_ids, self.nulls = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, np.uint8, docs, 8 * docs)
        self.lens = np.frombuffer(raw, "<i8", docs, 9 * docs)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)])
        self.frame_start = np.concatenate([[0], np.cumsum(self.sizes[:, 1] // width)])
        self.decompressed = 0

    def frame(self, k: int) -> np.ndarray:
        raw = zstandard.ZstdDecompressor().decompress(self.data[self.at[k] : self.at[k + 1]].tobytes(), max_output_size=int(self.sizes[k, 1]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        self.decompressed += 1
        return np.frombuffer(raw, self.kind)

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids of the file before it, its ids) of all or the wanted documents, by position in the file."""
        last, ids = -1, None
        for i in range(len(self.lens)) if wanted is None else wanted:
            a, b = int(self.starts[i]), int(self.starts[i + 1])
            doc = None if self.nulls[i] else int(self.doc_ids[i])
            if a == b:
                yield doc, a, np.empty(0, self.kind)
                continue
            k = int(np.searchsorted(self.frame_start, a, "right")) - 1
            if k != last:
                last, ids = k, self.frame(k)
            yield doc, a, ids[a - self.frame_start[k] : b - self.frame_start[k]]

    def find(self, doc_ids: Iterable[int]) -> list[int]:
        """Positions of the documents with these ids; the file is in ascending order, nulls first."""
        n = int(self.nulls.sum())
        out = []
        for d in doc_ids:
            a, b = np.searchsorted(self.doc_ids[n:], d, "left"), np.searchsorted(self.doc_ids[n:], d, "right")
            out += range(n + int(a), n + int(b))
        return out


def write_store(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 1, spaces: str = "dropped", width: int = 2, part_bytes: int = PART_BYTES) -> list[tuple]:
    """Encode whole texts (null: empty), append ``end_id`` to each, and write files in ascending doc_id order.

    Rows are dealt by ranges of (doc_id, hash of the text, number of the row), so neither repeated ids, null ids (which come first)
    nor repeated rows must meet in one task; a task gets about ``part_bytes`` of text. It writes frames to its one file, under a name
    of its own, as they are full; files of lost or repeated attempts are not in the result. Returns (rank, uri, documents, ids)
    for each file, in order.
    """
    spark = docs.sparkSession
    ship_package(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = StoreWriter(width=width), 0

        def parts(first: pa.Table, more: Iterator[pa.Table]) -> Iterator[bytes]:
            nonlocal n
            for t in chain([first], more):
                ids, borders = encoder(vocabulary, spaces).encode(t["text"])
                ids = np.insert(ids, borders[1:], end_id)
                n += len(ids)
                yield from out.add(t["doc_id"].to_pylist(), ids, borders + np.arange(len(borders)))
            yield from out.end()

        tables = (t for t in blocks(batches, most=BLOCK) if t.num_rows)
        first = next(tables, None)
        if first is not None:
            rank = TaskContext.get().partitionId()
            uri = f"{folder}/{rank:06d}-{uuid.uuid4().hex}.tokens"
            write_file(uri, parts(first, tables))
            yield pa.RecordBatch.from_pydict({"rank": [rank], "uri": [uri], "docs": [len(out.ids)], "ids": [n]})

    rows = doc_texts(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    order = ["doc_id", F.xxhash64("text"), "row"]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    got = dealt.select("doc_id", "text").mapInArrow(write, "rank long, uri string, docs long, ids long").collect()  # one row for each file
    return sorted((r.rank, r.uri, r.docs, r.ids) for r in got)


def read_store(spark: SparkSession, files: list[tuple]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from the files."""
    rows, base = [], 0
    for _, uri, _, ids in files:
        rows.append((uri, base))
        base += ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b["uri"].to_pylist(), b["base"].to_pylist(), strict=True):
                cols: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                for doc, start, ids in StoreReader(FileBytes(uri)).documents():
                    for name, value in zip(cols, (doc, base + start, len(ids), crc_ids(ids)), strict=True):
                        cols[name].append(value)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in cols.items()})

    listed = spark.createDataFrame(rows, "uri string, base long")
    if len(rows) > 1:
        listed = listed.repartition(len(rows))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Write the store to the shared folder and read it back: doc_id, start, n_tokens, ids_crc32 of each row.

    Null texts count as empty and get the end id alone; a null doc_id sorts first; repeated rows are all kept, and rows of one
    doc_id stand by the hash of their text, equal ones in any order; a very long text is one document in one frame; columns
    other than doc_id and text are ignored whatever their names; an empty table gives an empty result.
    """
    return read_store(spark, write_store(docs, vocabulary, shared_folder(spark, "tokens"), end_id))
