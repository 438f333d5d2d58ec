"""Best-fit decreasing packing of documents into sequences of a fixed number of tokens.

Documents longer than a sequence are first cut into full windows, each of which is a sequence of its own; what remains of each
document is one piece. These pieces are dealt by their numbers into bins of about ``GROUP`` pieces, and each bin is packed by
itself: pieces in descending length, each into the tightest open window. The padding that this adds over packing all pieces at
once is at most one open window for each length and bin, so it doesn't grow with the number of bins' pieces. A bin holds pieces of
documents, never whole ones, so its size doesn't depend on their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import blocks, doc_texts
from pagegrain.llm.tokens import crc_ids, encoder
from pagegrain.runtime import shared_folder, ship_package

WINDOW, GROUP, BLOCK = 1024, 50_000, 1 << 20


class CapacityTree:
    """A segment tree over remaining capacities 0..most, with a stack of open windows at each leaf."""

    def __init__(self, most: int):
        self.size = 1
        while self.size <= most:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        if len(self.open[capacity]) == 1:
            i = self.size + capacity
            while i:
                self.count[i] += 1
                i //= 2

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least ``need`` that an open window has, or -1."""
        i, count = self.size + need, self.count
        while not count[i]:
            while i & 1:  # go up while this is the right child
                i //= 2
                if i <= 1:
                    return -1
            i += 1
        while i < self.size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        return i - self.size

    def take(self, capacity: int) -> int:
        window = self.open[capacity].pop()
        if not self.open[capacity]:
            i = self.size + capacity
            while i:
                self.count[i] -= 1
                i //= 2
        return window


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece (1..capacity long) its window, counted from 0, and its place in the window."""
    tree, windows = CapacityTree(capacity), 0
    window, place = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = tree.tightest(need)
        if room < 0:
            w, room, windows = windows, capacity, windows + 1
        else:
            w = tree.take(room)
        window[i], place[i] = w, capacity - room
        if room > need:
            tree.put(room - need, w)
    return window, place


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, piece long"


def cut_documents(docs: DataFrame, vocabulary: str, end_id: int, window: int) -> DataFrame:
    """Pieces of each document: full windows, then the rest. ``piece`` tells the pieces of one evaluation apart."""
    ship_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for t in blocks(batches, most=BLOCK):
            ids, borders = encoder(vocabulary, "joined").encode(t["text"])
            ids = np.insert(ids, borders[1:], end_id).astype("<u4")
            borders = borders + np.arange(len(borders))
            tokens = np.diff(borders)
            n = -(-tokens // window)
            doc = np.repeat(np.arange(len(tokens)), n)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * window
            length = np.minimum(window, tokens[doc] - start)
            at = borders[doc] + start
            crc = np.array([crc_ids(ids[a : a + k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)], np.int64)
            piece = number + np.arange(len(doc))
            number += len(doc)
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks().take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens[doc], piece))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece"])

    return doc_texts(docs).mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Pieces with their sequence and offset: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated rows are packed each for itself, and dealt by the numbers of their pieces,
    so that they meet in no bin. A very long text is a sequence for each full window and one rest. Of pieces of equal length that
    with the smaller (doc_id, start, checksum) goes first. Sequence ids are unique, not gapless: odd for full windows, even for
    packed ones. Columns besides doc_id and text are ignored whatever their names; an empty table gives an empty result. Texts are
    encoded once: the pieces, some 40 bytes each, are a table in the shared folder.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "pieces")
    cut_documents(docs, vocabulary, end_id, window).write.parquet(folder)
    pieces = spark.read.schema(PIECES).parquet(folder)
    full, rest = pieces.filter(F.col("length") == window), pieces.filter(F.col("length") < window)
    bins = max(1, -(-rest.count() // group))
    dealt = rest.withColumn("bin", F.pmod(F.xxhash64("piece"), F.lit(bins)))

    def pack(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        w, place = best_fit_decreasing(p["length"].to_numpy(), window)
        return p.assign(sequence_id=2 * (w * bins + int(key[0])), offset=place)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    ship_package(spark)
    alone = full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (2 * F.col("piece") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.union(dealt.groupBy("bin").applyInPandas(pack, out))
