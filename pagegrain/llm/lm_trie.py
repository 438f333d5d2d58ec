"""Language-model scoring with an n-gram trie in Elias-Fano lists.

The model interpolates three orders: P3 = d(uvw)/c(uv) + g(uv) P2, P2 = d(vw)/c(v) + g(v) P1, P1 = (c + 0.1)/(N + 0.1 (V + 1)),
where d takes ``DISCOUNT`` from counts and g is the mass left over. Every n-gram of the training rows is kept. Words are known by
64-bit hashes; a word's number is its rank among all words.

Levels are files in the shared folder, in shards that grow in number with the input: words by ranges of their hashes,
bigrams together with the trigrams that go on from them by a hash of the bigram. A level is one monotone list: the
pointer of the context (its number in the level before, shifted) plus the word, so the successors of a context stand
together and a query is a successor search relative to its context. Probabilities are quantised to 16 bits of their
logarithm. A shard's files have names of their own by number, so tasks need no list of them; they are memory-mapped, never
broadcast. Of a store that can't be mapped a worker holds the files that it used last.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import blocks, doc_texts, drop_folder, map_file, mix64, only, tidy, write_file
from pagegrain.llm.words import NOT_SPACE, HashTable, Texts, runs
from pagegrain.runtime import shared_folder, ship_package

DISCOUNT, FOLDS, BLOCK = 0.75, 10, 4 << 20
END = np.uint64(0xE4D0E4D0E4D0E4D0)  # stands for the end of a text among the hashes of words
STEP = 2048  # quantised steps of a power of ten
#: Bytes of text for a shard, and the most shards (as a power of two).
SHARD_BYTES, MOST_BITS = 16 << 20, 20


def quantise(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.clip(np.rint(-np.log10(p) * STEP), 0, 65535).astype("<u2")


POWER = 10.0 ** (-np.arange(65536) / STEP)


def _select_table() -> np.ndarray:
    """The place of the j-th one of each byte, by 8 * byte + j."""
    out = np.zeros(256 * 8, np.uint64)
    for byte in range(256):
        ones = [k for k in range(8) if byte >> k & 1]
        out[8 * byte : 8 * byte + len(ones)] = ones
    return out


_SELECT = _select_table()
_FIVES, _THREES, _FIFTEENS, _ONES, _TOPS = (np.uint64(x * 0x0101010101010101) for x in (0x55, 0x33, 0x0F, 0x01, 0x80))
_U = [np.uint64(k) for k in range(65)]


class _Ones:
    """Words of 64 bits, with the number of ones up to each of their bytes."""

    def __init__(self, words: np.ndarray):
        self.words = words
        s = words - ((words >> _U[1]) & _FIVES)
        s = (s & _THREES) + ((s >> _U[2]) & _THREES)
        self.upto = ((s + (s >> _U[4])) & _FIFTEENS) * _ONES

    def place(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th one of each word, which must have it."""
        shift = np.bitwise_count(((k * _ONES) | _TOPS) - self.upto & _TOPS).astype(np.uint64) << _U[3]
        before = ((self.upto << _U[8]) >> shift) & np.uint64(255)
        return (shift + _SELECT[((((self.words >> shift) & np.uint64(255)) << _U[3]) + k - before).astype(np.int64)]).astype(np.int64)


class EliasFano:
    """An ascending list of distinct numbers: low bits packed, high parts as a bit vector with the zeros before each word."""

    @staticmethod
    def build(values: np.ndarray) -> bytes:
        n = len(values)
        if not n:
            return np.zeros(3, "<u8").tobytes()
        width = min(56, max(0, (int(values[-1]) // n).bit_length() - 1))
        high = (values >> np.uint64(width)).astype(np.int64)
        words = -(-(n + int(high[-1]) + 1) // 64)
        bits = np.zeros(words * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        upper = np.packbits(bits, bitorder="little").view("<u8")
        zeros = np.cumsum(64 - np.bitwise_count(upper).astype(np.int64))
        before = np.zeros(words + words % 2, "<u4")
        before[1:words] = zeros[:-1]
        low = []
        for k in range(0, n if width else 0, 1 << 16):
            part = values[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
            low.append(np.packbits(np.unpackbits(part, axis=1, bitorder="little")[:, :width].ravel(), bitorder="little").tobytes())
        return b"".join([np.array([n, width, words], "<u8").tobytes(), upper.tobytes(), before.tobytes(), *low, bytes(16)])

    def __init__(self, data: np.ndarray):
        self.n, self.width, words = (int(x) for x in data[:24].view("<u8"))
        if self.n:
            self.upper = data[24 : 24 + 8 * words].view("<u8")
            at = 24 + 8 * words
            self.zeros = data[at : at + 4 * words].view("<u4")
            at += 4 * (words + words % 2)
            self.low = np.ndarray((len(data) - at - 7,), "<u8", data, at, (1,))
            self.mask = np.uint64((1 << self.width) - 1)
            self.buckets = words * 64 - self.n

    def _lows(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.width
        return (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & self.mask

    def _bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The elements whose high part is h: they stand between the zero before the h-th and that."""
        k = h.astype(np.uint32)
        word = np.searchsorted(self.zeros, k, "right") - 1
        k = (k - self.zeros[word]).astype(np.uint64)
        open_ = _Ones(~self.upper[word])
        base = word * 64 - h
        end, begin = base + open_.place(k), np.zeros(len(h), np.int64)
        here = k > 0
        begin[here] = (base + open_.place(np.maximum(k, _U[1]) - _U[1]))[here] + 1
        back = np.flatnonzero(~here & (h > 0))
        if len(back):
            k = (h[back] - 1).astype(np.uint32)
            word = np.searchsorted(self.zeros, k, "right") - 1
            begin[back] = word * 64 + _Ones(~self.upper[word]).place((k - self.zeros[word]).astype(np.uint64)) - h[back] + 1
        return begin, end

    def find(self, x: np.ndarray) -> np.ndarray:
        """The index of each number, or -1: the first element not below it in its bucket is its successor."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        high = x >> np.uint64(self.width)
        on = np.flatnonzero(high < np.uint64(self.buckets))
        lo, end = self._bucket(high[on].astype(np.int64))
        keep = lo < end
        on, lo, end = on[keep], lo[keep], end[keep]
        if not self.width:
            out[on] = lo
            return out
        t, hi, live = x[on] & self.mask, end.copy(), np.flatnonzero(end - lo > 1)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._lows(mid) < t[live]
            lo[live], hi[live] = np.where(less, mid + 1, lo[live]), np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        inside = np.flatnonzero(lo < end)
        same = inside[self._lows(lo[inside]) == t[inside]]
        out[on[same]] = lo[same]
        return out


#: Files that a worker holds open, and bytes of those that aren't mapped.
MOST_OPEN, MOST_HELD = 20_000, 256 << 20


class Shelf:
    """The files of one model that a worker used last."""

    def __init__(self) -> None:
        self.held: OrderedDict[str, tuple[object, int]] = OrderedDict()
        self.bytes = 0

    def get(self, uri: str, make: Callable[[np.ndarray], object]) -> object:
        if uri not in self.held:
            raw, mapped = map_file(uri)
            size = 0 if mapped else len(raw)
            while self.held and (len(self.held) >= MOST_OPEN or self.bytes + size > MOST_HELD):
                self.bytes -= self.held.popitem(last=False)[1][1]
            self.held[uri] = make(raw), size
            self.bytes += size
        self.held.move_to_end(uri)
        return self.held[uri][0]


class Files:
    """The files of a model by kind and shard; ``name`` tells models apart."""

    def __init__(self, folder: str):
        self.folder = folder

    def uri(self, kind: str, shard: int) -> str:
        return f"{self.folder}/{kind}/{shard:06d}"

    def write(self, kind: str, shard: int, raw: bytes) -> None:
        """Put a file in place whole; a repeated attempt makes the same bytes."""
        write_file(self.uri(kind, shard), [raw])

    def array(self, kind: str, shard: int, dtype: str) -> np.ndarray:
        return shelf(self.folder).get(self.uri(kind, shard), lambda raw: raw.view(dtype))

    def list(self, kind: str, shard: int) -> EliasFano:
        return shelf(self.folder).get(self.uri(kind, shard), EliasFano)


class Vocabulary:
    """Numbers and training counts of words, by their hashes; shards are ranges of hashes. ``sizes``: words of each shard."""

    def __init__(self, files: Files, bits: int, sizes: np.ndarray):
        self.files, self.bits, self.sizes = files, bits, sizes
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        self.masses = np.zeros(len(sizes), bool)  # the shards whose back-off masses are known
        self.n = int(self.base[-1])
        if self.n >= 1 << 32:
            raise ValueError("a model holds at most 2**32 distinct words")
        self.word_bits = max(1, self.n.bit_length())

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number (-1: unknown), count and back-off mass of each hash; the hashes must ascend."""
        number, count, gamma = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), np.ones(len(hashes))
        shard = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        for s in np.unique(shard).tolist():
            if not self.sizes[s]:
                continue
            a, b = np.searchsorted(shard, [s, s + 1])
            got = self.files.list("words", s).find(hashes[a:b])
            hit = np.flatnonzero(got >= 0)
            number[a + hit] = got[hit] + self.base[s]
            count[a + hit] = self.files.array("counts", s, "<i8")[got[hit]]
            if self.masses[s]:
                gamma[a + hit] = POWER[self.files.array("masses", s, "<u2")[got[hit]]]
        return number, count, gamma


class WordTable:
    """Numbers, counts and masses of the words met so far by a worker; emptied when it is full."""

    def __init__(self, vocabulary: Vocabulary, most: int = 500_000):
        self.vocabulary, self.most = vocabulary, most
        self._clear()

    def _clear(self) -> None:
        self.table = HashTable()
        self.values = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.table.n > self.most:
            self._clear()
        zero = np.zeros(len(h), np.uint64)
        rows = self.table.find(h, zero)
        miss = rows < 0
        if miss.any():
            new = np.unique(h[miss])
            self.values = [np.concatenate([v, x]) for v, x in zip(self.values, self.vocabulary.find(new), strict=True)]
            self.table.add(new, zero[: len(new)])
            rows[miss] = self.table.find(h[miss], zero[miss])
        return tuple(v[rows] for v in self.values)


class Stream:
    """The tokens of some texts: words, then one end for each text."""

    def __init__(self, column: pa.ChunkedArray):
        words = runs(Texts(column, lower=True), NOT_SPACE)
        self.hashes = np.insert(words.hashes, words.first[1:], END)
        self.first = words.first + np.arange(len(words.first))
        self.begins = np.zeros(len(self.hashes), bool)
        self.begins[self.first[:-1]] = True
        self.owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _counted(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.empty(0, np.int64)
    return sorted_[new], np.diff(np.concatenate([new, [len(sorted_)]]))


def _by_number(shard: np.ndarray) -> np.ndarray:
    return np.argsort(shard.astype(np.uint16 if len(shard) and shard.max() < 1 << 16 else np.uint32), kind="stable")


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys (high halves as differences) and counts, byte by byte of all numbers, which compresses well."""
    high, low = (keys >> np.uint64(32)).astype("<u4"), (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
    parts = np.concatenate([np.diff(high, prepend=np.uint32(0)).astype("<u4"), low, counts.astype("<u4")])
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(np.ascontiguousarray(parts.view(np.uint8).reshape(-1, 4).T).data)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    parts = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().reshape(3, -1)
    return (np.cumsum(parts[0], dtype=np.uint64) << np.uint64(32)) | parts[1], parts[2]


def _deal(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each shard; keys ascend in each."""
    order = _by_number(shard)
    keys, counts, shard = keys[order], counts[order], shard[order]
    borders = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else []
    blobs = [_packed(keys[a:b], counts[a:b]) for a, b in zip(borders[:-1], borders[1:], strict=True)]
    yield pa.RecordBatch.from_pydict({"shard": pa.array(shard[borders[:-1]] if len(shard) else [], pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _merge(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a shard with their sums, ascending."""
    keys, counts = zip(*[_unpacked(blob) for blob in t["blob"].to_pylist()], strict=True)
    key, count = np.concatenate(keys), np.concatenate(counts)
    del keys, counts
    order = np.argsort(key, kind="stable")
    key, upto = key[order], np.cumsum(count[order], dtype=np.int64)
    last = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]]))
    return key[last], np.diff(upto[last], prepend=0)


class Trie:
    """Bigrams and trigrams over a vocabulary, in shards by the bigram; ``two`` and ``three`` say which shards have any."""

    def __init__(self, vocabulary: Vocabulary, bits: int):
        self.vocabulary, self.bits, self.files = vocabulary, bits, vocabulary.files
        self.two, self.three = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)

    def shard(self, key: np.ndarray) -> np.ndarray:
        return (mix64(key) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pointed(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return (context.astype(np.uint64) << np.uint64(self.vocabulary.word_bits)) | word.astype(np.uint64)

    def bigrams(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shard, node (-1: not there), probability part and back-off mass of ascending bigrams (number << 32 | number)."""
        shard, node = self.shard(keys), np.full(len(keys), -1, np.int64)
        p, g = np.zeros(len(keys)), np.ones(len(keys))
        for s, at in self._by_shard(shard):
            if not self.two[s]:
                continue
            context, back = np.unique(keys[at] >> np.uint64(32), return_inverse=True)
            k = self.files.list("contexts", s).find(context)[back]
            at, k = at[k >= 0], k[k >= 0]
            got = self.files.list("pairs", s).find(self._pointed(k, keys[at] & np.uint64(0xFFFFFFFF)))
            at, got = at[got >= 0], got[got >= 0]
            node[at], p[at] = got, POWER[self.files.array("pair-probabilities", s, "<u2")[got]]
            if self.three[s]:
                g[at] = POWER[self.files.array("pair-masses", s, "<u2")[got]]
        return shard, node, p, g

    def trigrams(self, shard: np.ndarray, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        p = np.zeros(len(node))
        for s, at in self._by_shard(shard):
            if not self.three[s]:
                continue
            key, back = np.unique(self._pointed(node[at], word[at]), return_inverse=True)
            got = self.files.list("triples", s).find(key)
            hit = got >= 0
            found = np.zeros(len(key))
            found[hit] = POWER[self.files.array("triple-probabilities", s, "<u2")[got[hit]]]
            p[at] = found[back]
        return p

    def _by_shard(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = _by_number(shard)
        ordered = shard[order]
        borders = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])) if len(order) else []
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            yield int(ordered[a]), order[a:b]


def _pairs(stream: Stream, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of second words of bigrams of known words, and the bigrams."""
    known = number >= 0
    at = np.flatnonzero(~stream.begins[1:] & known[1:] & known[:-1]) + 1
    return at, (number[at - 1].astype(np.uint64) << np.uint64(32)) | number[at].astype(np.uint64)


class Desk:
    """What a worker keeps of a model between tasks; another model's desk takes its place."""

    def __init__(self) -> None:
        self.shelf, self.tables = Shelf(), {}


def shelf(folder: str) -> Shelf:
    return only(folder, Desk).shelf


def _words(vocabulary: Vocabulary, stage: str) -> WordTable:
    """The worker's table of words; masses are known in scoring alone, so a stage has a table of its own."""
    tables = only(vocabulary.files.folder, Desk).tables
    if stage not in tables:
        tables.clear()
        tables[stage] = WordTable(vocabulary)
    return tables[stage]


SHARDED = "shard long, blob binary"


def train(docs: DataFrame) -> tuple[Trie, int]:
    """The model of all rows of ``docs``, and its number of tokens.

    Three passes over the texts count words, pairs and triples; each block of a task sends every n-gram once with its count.
    """
    spark = docs.sparkSession
    ship_package(spark)
    files, rows = Files(shared_folder(spark, "lm")), doc_texts(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(4, int(size // SHARD_BYTES).bit_length()))

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches, most=BLOCK):
            key, n = _counted(np.sort(Stream(t["text"]).hashes))
            yield from _deal(key, n, (key >> np.uint64(64 - bits)).astype(np.int64))

    def build_words(t: pa.Table) -> pa.Table:
        s = t["shard"][0].as_py()
        key, n = _merge(t)
        files.write("words", s, EliasFano.build(key))
        files.write("counts", s, n.astype("<i8").tobytes())
        return pa.table({"shard": [s], "n": [len(key)], "tokens": [int(n.sum())]})

    built = rows.mapInArrow(send_words, SHARDED).groupBy("shard").applyInArrow(tidy(build_words), "shard long, n long, tokens long").collect()  # three numbers a shard
    sizes = np.zeros(1 << bits, np.int64)
    sizes[[r.shard for r in built]] = [r.n for r in built]
    vocabulary = Vocabulary(files, bits, sizes)
    trie, tokens = Trie(vocabulary, bits), sum(r.tokens for r in built)

    def send_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _words(vocabulary, "train")
        for t in blocks(batches, most=BLOCK):
            stream = Stream(t["text"])
            key, n = _counted(np.sort(_pairs(stream, look(stream.hashes)[0])[1]))
            yield from _deal(key, n, trie.shard(key))

    base = vocabulary.base

    def build_pairs(t: pa.Table) -> pa.Table:
        s = t["shard"][0].as_py()
        key, n = _merge(t)
        first = (key >> np.uint64(32)).astype(np.int64)
        context, k = np.unique(first, return_inverse=True)
        total = np.zeros(len(context), np.int64)
        home = np.searchsorted(base, context, "right") - 1
        borders = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]]))
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            total[a:b] = files.array("counts", int(home[a]), "<i8")[context[a:b] - base[home[a]]]
        p = (n - DISCOUNT) / total[k]
        sums = np.bincount(k, p, len(context))
        files.write("contexts", s, EliasFano.build(context.astype(np.uint64)))
        files.write("pairs", s, EliasFano.build((k.astype(np.uint64) << np.uint64(vocabulary.word_bits)) | (key & np.uint64(0xFFFFFFFF))))
        files.write("pair-probabilities", s, quantise(p).tobytes())
        files.write("pair-counts", s, n.astype("<f8" if n.max() >= 1 << 32 else "<u4").tobytes())
        out: dict[str, list] = {"shard": [s], "home": [-1], "blob": [b""]}
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            out["shard"].append(-1)
            out["home"].append(int(home[a]))
            out["blob"].append((context[a:b] - base[home[a]]).astype("<i8").tobytes() + sums[a:b].astype("<f8").tobytes())
        return pa.table({"shard": pa.array(out["shard"], pa.int64()), "home": pa.array(out["home"], pa.int64()), "blob": pa.array(out["blob"], pa.binary())})

    folder = f"{files.folder}-pairs"
    rows.mapInArrow(send_pairs, SHARDED).groupBy("shard").applyInArrow(tidy(build_pairs), "shard long, home long, blob binary").write.parquet(folder)
    pairs = spark.read.schema("shard long, home long, blob binary").parquet(folder)
    trie.two[[r.shard for r in pairs.filter("shard >= 0").select("shard").collect()]] = True  # a number a shard

    def build_masses(t: pa.Table) -> pa.Table:
        s = t["home"][0].as_py()
        used = np.zeros(sizes[s])
        for blob in t["blob"].to_pylist():
            m = len(blob) // 16
            used[np.frombuffer(blob, "<i8", m)] += np.frombuffer(blob, "<f8", m, 8 * m)
        files.write("masses", s, quantise(1 - np.minimum(used, 1 - 1e-9)).tobytes())
        return pa.table({"home": [s]})

    homes = [r.home for r in pairs.filter("home >= 0").select("home", "blob").groupBy("home").applyInArrow(tidy(build_masses), "home long").collect()]
    drop_folder(folder)

    def send_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _words(vocabulary, "train")
        for t in blocks(batches, most=BLOCK):
            stream = Stream(t["text"])
            number = look(stream.hashes)[0]
            at, key = _pairs(stream, number)
            distinct, back = np.unique(key, return_inverse=True)
            shard, node, _, _ = trie.bigrams(distinct)
            follows = np.flatnonzero(at[1:] == at[:-1] + 1) + 1
            s, context, word = shard[back[follows - 1]], node[back[follows - 1]], number[at[follows]]
            key = (context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)
            order = np.lexsort((key, s))
            key, s = key[order], s[order]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (s[1:] != s[:-1])])) if len(key) else np.empty(0, np.int64)
            yield from _deal(key[new], np.diff(np.concatenate([new, [len(key)]])), s[new])

    def build_triples(t: pa.Table) -> pa.Table:
        s = t["shard"][0].as_py()
        key, n = _merge(t)
        context = (key >> np.uint64(32)).astype(np.int64)
        total = files.array("pair-counts", s, "u1")
        pairs = files.list("pairs", s).n
        total = total.view("<u4" if len(total) == 4 * pairs else "<f8")
        p = (n - DISCOUNT) / total[context]
        used = np.bincount(context, p, len(total))
        files.write("triples", s, EliasFano.build((context.astype(np.uint64) << np.uint64(vocabulary.word_bits)) | (key & np.uint64(0xFFFFFFFF))))
        files.write("triple-probabilities", s, quantise(p).tobytes())
        files.write("pair-masses", s, quantise(1 - np.minimum(used, 1 - 1e-9)).tobytes())
        return pa.table({"shard": [s]})

    there = [r.shard for r in rows.mapInArrow(send_triples, SHARDED).groupBy("shard").applyInArrow(tidy(build_triples), "shard long").collect()]
    drop_folder(f"{files.folder}/pair-counts")
    trie.three[there] = True
    vocabulary.masses[homes] = True
    return trie, tokens


def score(docs: DataFrame, trie: Trie, tokens: int) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row; no shuffle."""
    ship_package(docs.sparkSession)
    vocabulary = trie.vocabulary
    below = tokens + 0.1 * (vocabulary.n + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _words(vocabulary, "score")
        for t in blocks(batches, most=BLOCK):
            stream = Stream(t["text"])
            number, count, gamma = look(stream.hashes)
            p1 = (count + 0.1) / below
            p = p1.copy()
            inner = np.flatnonzero(~stream.begins)
            p[inner] *= gamma[inner - 1]
            at, key = _pairs(stream, number)
            distinct, back = np.unique(key, return_inverse=True)
            shard, node, p2, g2 = trie.bigrams(distinct)
            there = node[back] >= 0
            at, back = at[there], back[there]
            p[at] += p2[back]
            # places whose context of two words is in the trie
            ahead = at + 1
            ok = ahead < len(p)
            ok[ok] &= ~stream.begins[ahead[ok]]
            ahead, back = ahead[ok], back[ok]
            p[ahead] *= g2[back]
            ok = number[ahead] >= 0
            ahead, back = ahead[ok], back[ok]
            p[ahead] += trie.trigrams(shard[back], node[back], number[ahead])
            docs_here = len(stream.first) - 1
            add = lambda x: np.bincount(stream.owner, x, docs_here)
            known = add(count > 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [t["doc_id"].combine_chunks(), pa.array(np.diff(stream.first), pa.int64()), pa.array(known), pa.array(np.full(docs_here, tokens), pa.int64()), pa.array(add(np.log10(p1))), pa.array(add(np.log10(p)))],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: str = "doc_id", folds: int = FOLDS) -> F.Column:
    """Whether a row's fold is 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == 0


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score: train on the rows that aren't held out, score every row.

    Null and empty texts are the end alone. Without training rows every token has the probability of an unknown word, and an empty
    table gives an empty result. Repeated rows count each time and have equal scores; nothing is ordered, so ties don't arise. A
    very long text is counted and scored whole, in a block of its own. Columns besides doc_id and text are ignored whatever their
    names.
    """
    trie, tokens = train(doc_texts(docs).filter(~held_out()))
    return score(docs, trie, tokens).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
