"""Benchmark decontamination with an FM-index for each shard of training text.

A shard is a block of whole documents (about 4 MB of text). Its words become symbols of the phrases' alphabet. A word that no
phrase holds ends every occurrence, so a run of such words is one separator in the indexed string; runs of known words
shorter than the shortest phrase can't hold one and are left out. All this loses no occurrence. Over the string the
suffix array gives the Burrows-Wheeler transform, which a wavelet tree holds as rank-indexed bit vectors. All test
phrases of a block are searched backwards at once; their occurrences are located by walking to sampled suffix positions, and
overlapping occurrences merge to removal spans.
"""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import blocks, doc_texts, only, ragged, read_file, tidy, write_file
from pagegrain.llm.words import LETTER_OR_DIGIT, HashTable, Texts, Words, runs
from pagegrain.runtime import shared_folder, ship_package

WIDTH, SAMPLE, PHRASE_WORDS, SHARD = 10, 8, 1_000_000, 4 << 20


class WaveletTree:
    """Rank and access over a sequence of small integers, level by level as one bit vector each."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.n, self.depth = len(values), max(1, int(sigma - 1).bit_length())
        self.words, self.ones, self.zeros = [], [], []
        cur = values
        for level in range(self.depth - 1, -1, -1):
            bit = (cur >> level) & 1 == 1
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")
            self.words.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(self.n - bit.sum()))
            cur = np.concatenate([cur[~bit], cur[bit]])
        self.origin = self._descend(np.arange(1 << self.depth), np.zeros(1 << self.depth, np.int64))

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[level][w] + np.bitwise_count(self.words[level][w] & below)

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.depth):
            one = self._ones(level, i)
            i = np.where((c >> (self.depth - 1 - level)) & 1 == 1, self.zeros[level] + one, i - one)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before i."""
        return self._descend(c, i) - self.origin[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and its rank there."""
        c = np.zeros(len(i), np.int64)
        for level in range(self.depth):
            bit = (self.words[level][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            one = self._ones(level, i)
            i = np.where(bit, self.zeros[level] + one, i - one)
            c = 2 * c + bit
        return c, i - self.origin[c]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By doubling prefixes. Separators (0) sort first, by place, so that no comparison goes past one."""
    n = len(symbols)
    rank = symbols.astype(np.int64) + n
    gaps = np.flatnonzero(symbols == 0)
    rank[gaps] = np.arange(len(gaps))
    k, order = 1, np.argsort(rank, kind="stable")
    while True:
        sorted_ = rank[order]
        new = np.cumsum(np.concatenate([[0], (sorted_[1:] != sorted_[:-1]).astype(np.int64)])) if n else order
        rank = np.empty(n, np.int64)
        rank[order] = new
        if not n or new[-1] == n - 1:
            return order
        ahead = np.zeros(n, np.int64)
        ahead[:-k] = rank[k:] + 1
        rank = rank * (n + 1) + ahead
        order = np.argsort(rank, kind="stable")
        k *= 2


class FMIndex:
    """Over a string of symbols 1.. with separators 0; the string must end with a separator."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        order = suffix_array(symbols)
        self.n = len(symbols)
        before = symbols[order - 1]  # of place 0 the last, a separator
        self.tree = WaveletTree(before, sigma)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << self.tree.depth))])
        kept = (order % SAMPLE == 0) | (before == 0)
        self.sampled, self.samples = kept, order[kept]
        self.nth = np.cumsum(kept) - 1

    def count(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the phrases (rows of symbols, left-aligned), by backward search of all at once."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(phrases.shape[1] if len(phrases) else 0):
            on = np.flatnonzero((lengths > step) & (lo < hi))
            c = phrases[on, lengths[on] - 1 - step]
            lo[on] = self.below[c] + self.tree.rank(c, lo[on])
            hi[on] = self.below[c] + self.tree.rank(c, hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the string, by walking backwards to the next sampled suffix."""
        out = np.zeros(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(left):
            done = self.sampled[rows]
            out[left[done]] = self.samples[self.nth[rows[done]]] + steps
            left, rows = left[~done], rows[~done]
            c, r = self.tree.access(rows)
            rows, steps = self.below[c] + r, steps + 1
        return out


class PhraseBlock:
    """The windows of some benchmark items, their alphabet, and which items each window belongs to."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        texts = Texts(pa.array([t for _, t in items], pa.binary()), lower=True)
        words = runs(texts, LETTER_OR_DIGIT)
        names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(names)}
        owner = np.array([number[name] for name, _ in items], np.int64)
        h, heads = words.hashes, words.heads
        both = np.rec.fromarrays([h, heads])
        _, first, inverse = np.unique(both, return_index=True, return_inverse=True)
        symbols = inverse.astype(np.int64) + 1
        n = words.counts
        windows = np.where(n > 0, np.maximum(1, n - width + 1), 0)
        item = np.repeat(np.arange(len(n)), windows)
        at = words.first[:-1][item] + (np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows))
        size = np.minimum(n[item], width)
        grid = np.zeros((len(item), width), np.int32)
        for k in range(width):
            on = size > k
            grid[on, k] = symbols[at[on] + k]
        phrases, back = np.unique(grid, axis=0, return_inverse=True) if len(grid) else (grid, np.zeros(0, np.int64))
        pairs = np.unique(back.ravel() * (len(names) + 1) + owner[item]) if len(grid) else back
        self._hold(names, h[first], heads[first], phrases, pairs)

    def _hold(self, names: list[str], keys: np.ndarray, heads: np.ndarray, phrases: np.ndarray, pairs: np.ndarray) -> None:
        self.names, self.phrases, self.pairs = names, phrases, pairs
        self.alphabet = HashTable()
        self.alphabet.add(keys, heads)
        self.lengths = (phrases > 0).sum(axis=1)
        self.pair_item = pairs % (len(names) + 1)
        self.pair_first = np.searchsorted(pairs // (len(names) + 1), np.arange(len(phrases) + 1))
        self.shortest = int(self.lengths.min()) if len(phrases) else 0

    def dump(self) -> bytes:
        """The block as plain arrays."""
        names = [x.encode() for x in self.names]
        n, out = self.alphabet.n, io.BytesIO()
        np.savez(out, names=np.frombuffer(b"".join(names), np.uint8), sizes=np.array(list(map(len, names)), np.int64), keys=self.alphabet.keys[:n], heads=self.alphabet.heads[:n], phrases=self.phrases, pairs=self.pairs)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> PhraseBlock:
        block, got = cls.__new__(cls), np.load(io.BytesIO(raw), allow_pickle=False)
        ends, joined = np.cumsum(got["sizes"]), got["names"].tobytes()
        names = [joined[b - n : b].decode() for b, n in zip(ends.tolist(), got["sizes"].tolist(), strict=True)]
        block._hold(names, got["keys"], got["heads"], got["phrases"], got["pairs"])
        return block

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Of a shard's words: whether each lies in an occurrence, and the distinct (text, item) pairs."""
        hit = np.zeros(len(words) + 1, np.int64)
        none = np.zeros((0, 2), np.int64)
        if not len(self.phrases) or not len(words):
            return hit[:-1] > 0, none
        symbols = self.alphabet.find(words.hashes, words.heads) + 1
        known = symbols > 0
        joined = np.zeros(len(words) + 1, bool)  # this word and the one before are both known, in one text
        joined[1:-1] = known[1:] & known[:-1]
        joined[words.first] = False
        starts = np.flatnonzero(known & ~joined[:-1])
        sizes = np.flatnonzero(known & ~joined[1:]) + 1 - starts
        starts, sizes = starts[sizes >= self.shortest], sizes[sizes >= self.shortest]
        if not len(starts):
            return hit[:-1] > 0, none
        place = ragged(starts, sizes + 1)  # the place after each run becomes its separator
        string = np.where(np.arange(len(place)) == np.repeat(np.cumsum(sizes + 1) - 1, sizes + 1), 0, symbols[np.minimum(place, len(symbols) - 1)])
        index = FMIndex(string, self.alphabet.n + 1)
        lo, hi = index.count(self.phrases, self.lengths)
        text_of = np.repeat(np.arange(len(words.texts)), words.counts)
        found = []
        for part in np.array_split(np.flatnonzero(hi > lo), 1 + int((hi - lo).sum() >> 20)):
            which = np.repeat(part, hi[part] - lo[part])
            at = place[index.locate(ragged(lo[part], hi[part] - lo[part]))]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + self.lengths[which], -1)
            pairs = np.unique(text_of[at] * len(self.phrases) + which)
            text, which = pairs // len(self.phrases), pairs % len(self.phrases)
            n = self.pair_first[which + 1] - self.pair_first[which]
            item = self.pair_item[ragged(self.pair_first[which], n)]
            found.append(np.unique(np.stack([np.repeat(text, n), item], 1), axis=0))
        return np.cumsum(hit[:-1]) > 0, np.unique(np.concatenate(found), axis=0) if found else none


def write_phrases(benchmark: DataFrame, width: int, most_words: int = PHRASE_WORDS) -> list[str]:
    """Phrase blocks of about a bounded number of words, built by the executors as files of the shared folder; an item that is repeated with
    its text counts once. Returns their uris, one for each ``most_words`` words of the benchmark."""
    spark = benchmark.sparkSession
    ship_package(spark)
    folder = shared_folder(spark, "phrases")
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text")).filter("text <> ''").distinct()
    words = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 4
    parts = 1 + words // most_words
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        uri = f"{folder}/{t['part'][0].as_py():05d}-{uuid.uuid4().hex}.phrases"
        write_file(uri, [PhraseBlock(list(zip(t["item"].to_pylist(), (x.encode() for x in t["text"].to_pylist()), strict=True)), width).dump()])
        return pa.table({"uri": [uri]})

    return sorted(r.uri for r in dealt.groupBy("part").applyInArrow(tidy(build), "uri string").collect())


#: Phrase blocks that a worker keeps at a time.
KEPT = 3


def _phrases(uri: str, uris: list[str]) -> PhraseBlock:
    held = only(tuple(uris), OrderedDict)
    if uri not in held:
        while len(held) >= KEPT:
            held.popitem(last=False)
        held[uri] = PhraseBlock.load(read_file(uri))
    held.move_to_end(uri)
    return held[uri]


def _block(uris: list[str]) -> int:
    """Bytes of text in a shard: more where phrase blocks have to be read again for each of them."""
    return SHARD if len(uris) <= KEPT else 4 * SHARD


class Matches:
    """What all phrase blocks find in one shard."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, uris: list[str]):
        self.words = runs(Texts(column, lower=True), LETTER_OR_DIGIT)
        self.hit = np.zeros(len(self.words), bool)
        self.items: dict[int, set[str]] = {}
        for uri in uris:
            block = _phrases(uri, uris)
            hit, pairs = block.search(self.words)
            self.hit |= hit
            for text, item in pairs.tolist():
                self.items.setdefault(text, set()).add(block.names[item])
        self.n_hit = np.diff(np.concatenate([[0], np.cumsum(self.hit)])[self.words.first])

    def spans(self) -> list[list[tuple[int, int]]]:
        """Merged removal spans of each text, as offsets of its UTF-8 bytes."""
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(self.words.texts))]
        first, hit, w = self.words.first, self.hit, self.words
        for i in np.flatnonzero(self.n_hit).tolist():
            h = np.flatnonzero(np.diff(np.concatenate([[False], hit[first[i] : first[i + 1]], [False]]).astype(np.int8))).reshape(-1, 2)
            base = int(w.texts.offsets[i])
            out[i] = [(int(w.starts[first[i] + a]) - base, int(w.ends[first[i] + b - 1]) - base) for a, b in h.tolist()]
        return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, items (array of item ids as strings, sorted), spans (array of start and end bytes).

    A null text has no words; an item without words has no window; an item of fewer than ``width`` words is one window;
    repeated documents and items are each found; overlapping windows and those of equal text count each place once; without
    benchmark rows nothing is hit; columns besides doc_id and text are ignored whatever their names; an empty table gives an
    empty result. A very long text is a shard of its own, whole. No shuffle of documents: each lies in one shard, and phrase
    blocks (bounded in size) are read one after another.
    """
    ship_package(docs.sparkSession)
    uris = write_phrases(benchmark, width)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches, most=_block(uris)):
            m = Matches(t["text"], uris)
            n = t.num_rows
            spans = [[{"start": a, "end": b} for a, b in s] for s in m.spans()]
            yield pa.RecordBatch.from_arrays(
                [t["doc_id"].combine_chunks(), pa.array(m.words.counts, pa.int64()), pa.array(m.n_hit, pa.int64()), pa.array([sorted(m.items.get(i, ())) for i in range(n)], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return doc_texts(docs).mapInArrow(scan, "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")


def contamination_report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row, from ``find_contamination``; the same cases hold."""
    found = find_contamination(docs, benchmark, width)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text holds no window of the benchmark.

    Null and empty texts hold none and stay, as do rows without an id; each of some repeated rows is kept or dropped alike; without
    benchmark rows all stay.
    """
    ship_package(docs.sparkSession)
    uris = write_phrases(benchmark, width)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches, most=_block(uris)):
            yield from t.filter(pa.array(Matches(t["text"].cast(pa.string()), uris).n_hit == 0)).to_batches()

    return docs.mapInArrow(keep, docs.schema)


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the spans, which are offsets of its UTF-8 bytes."""
    raw, at, out = text.encode(), 0, []
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]).decode()
