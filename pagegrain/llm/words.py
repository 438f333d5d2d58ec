"""Words of whole Arrow text columns, found and hashed with numpy, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash

from pagegrain.llm.common import M1, M2, M3, mix64

_CODES = np.arange(256)
#: Fixed classes of bytes, as the contracts of the operators give them.
ASCII_SPACE = (_CODES == 0x20) | ((_CODES >= 0x09) & (_CODES <= 0x0D))
NOT_SPACE = ~ASCII_SPACE
LETTER_OR_DIGIT = ((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES >= 0x61) & (_CODES <= 0x7A)) | (_CODES >= 0x80)
LOWER = np.where((_CODES >= 0x41) & (_CODES <= 0x5A), _CODES + 32, _CODES).astype(np.uint8)

#: Words of more bytes than this are hashed and compared one by one; there are few of them.
_LONG = 256
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def lanes(data: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each start as a number, zero beyond the ``left`` bytes of the span; ``data`` has eight bytes to spare."""
    view = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    return view[starts] & _KEEP[np.minimum(left, 8)]


class Texts:
    """UTF-8 bytes of a text column; null counts as empty. ``offsets`` has one border more than texts."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        column = column.cast(pa.large_binary()) if column.null_count == 0 else column.fill_null("").cast(pa.large_binary())
        n = len(column)
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        size = int(off[-1] - off[0])
        self.data = np.zeros(size + 8, np.uint8)  # eight bytes more, for reading words at once
        if size:
            raw = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
            self.data[:size] = LOWER[raw] if lower else raw
        self.offsets, self.size = off - off[0], size

    def __len__(self) -> int:
        return len(self.offsets) - 1


class Words:
    """Borders of words, and for each text the first of its words (one entry more than texts)."""

    def __init__(self, texts: Texts, starts: np.ndarray, ends: np.ndarray):
        self.texts, self.starts, self.ends = texts, starts, ends
        self.first = np.searchsorted(starts, texts.offsets)
        self._hash = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hashes(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hash_spans(self.texts.data, self.starts, self.ends)
        return self._hash

    @property
    def heads(self) -> np.ndarray:
        """The first eight bytes of each word, zero beyond its end."""
        return lanes(self.texts.data, self.starts, self.ends - self.starts)

    def word(self, i: int) -> bytes:
        return self.texts.data[self.starts[i] : self.ends[i]].tobytes()


def runs(texts: Texts, member: np.ndarray, cut: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes for which ``member`` holds, inside each text; where ``cut`` is true a new run begins."""
    inside = member[texts.data[: texts.size]]
    follows = np.empty(texts.size + 1, bool)  # a run goes on from the byte before
    follows[0], follows[1:] = False, inside
    follows[:-1] &= inside
    follows[-1] = False
    follows[texts.offsets] = False
    if cut is not None:
        follows[:-1] &= ~cut
    starts = np.flatnonzero(inside & ~follows[:-1])
    ends = np.flatnonzero(inside & ~follows[1:]) + 1
    return Words(texts, starts, ends)


_KIND = np.zeros(256, np.uint8)  # 0: space, control, apostrophe and all beyond ASCII
_KIND[0x21:0x7F], _KIND[0x27] = 3, 0
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_KIND[0x30:0x3A] = 2


def kind_cuts(texts: Texts) -> np.ndarray | None:
    """True where an ASCII letter, digit or mark follows one of another kind; None if a special string may be there.

    No pre-token of the public vocabularies goes on there. Bytes outside ASCII may combine with the one before, and
    apostrophes may begin a contraction, so there is no cut beside them.
    """
    raw = texts.data[: texts.size]
    if b"<|" in memoryview(raw).tobytes():
        return None
    kind = _KIND[raw]
    cut = np.zeros(texts.size, bool)
    cut[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    return cut


def space_chunks(texts: Texts, cut: np.ndarray | None = None) -> Words:
    """Pieces that begin at single spaces between other characters, and where ``cut`` is true; they cover every byte.

    Next to any control byte, or to bytes that may belong to white space outside ASCII, no space begins a piece.
    """
    n = texts.size
    d = np.zeros(n + 6, np.uint8)
    d[3 : n + 3] = texts.data[:n]
    low = d <= 0x20
    maybe = np.zeros(n + 6, bool)  # of a first byte
    if (d >= 0x80).any():
        a, b = d[:-1], d[1:]
        maybe[:-1] = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))
    begins = (d[3 : n + 3] == 0x20) & ~(low[2 : n + 2] | low[4 : n + 4] | maybe[4 : n + 4] | maybe[1 : n + 1] | maybe[:n])
    if cut is not None:
        begins |= cut
    begins = np.append(begins, False)
    begins[texts.offsets] = True
    begins[-1] = False
    starts = np.flatnonzero(begins)
    return Words(texts, starts, np.append(starts[1:], n) if len(starts) else starts)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, whose ``data`` has eight bytes to spare: a mix of eight bytes after another, from the length on."""
    size = ends - starts
    out = mix64(size.astype(np.uint64) * M3 + M1)
    on = None  # the spans that go on
    for k in range(0, _LONG, 8):
        if on is None:
            out = mix64(out ^ lanes(data, starts, size))
            on = np.flatnonzero((size > 8) & (size <= _LONG))
        else:
            out[on] = mix64(out[on] * M2 ^ lanes(data, starts[on] + k, size[on] - k))
            on = on[size[on] > k + 8]
        if not len(on):
            break
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].data, seed=int(M1))
    return out


class HashTable:
    """Open addressing from (64-bit hash, first eight bytes) to consecutive numbers."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys, self.heads = np.empty(1 << 12, np.uint64), np.empty(1 << 12, np.uint64)

    def find(self, h: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        last = (1 << self.bits) - 1
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.slots[at]
        open_ = np.flatnonzero(got >= 0)
        while len(open_):
            g = got[open_]
            open_ = open_[(self.keys[g] != h[open_]) | (self.heads[g] != heads[open_])]
            at[open_] = (at[open_] + 1) & last
            got[open_] = self.slots[at[open_]]
            open_ = open_[got[open_] >= 0]
        return got

    def add(self, h: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Numbers for keys that are distinct and not in the table."""
        new = np.arange(self.n, self.n + len(h))
        while self.n + len(h) > len(self.keys):
            self.keys, self.heads = (np.concatenate([a, np.empty_like(a)]) for a in (self.keys, self.heads))
        self.keys[new], self.heads[new] = h, heads
        self.n += len(h)
        if self.n * 2 > 1 << self.bits:
            while self.n * 2 > 1 << self.bits:
                self.bits += 1
            self.slots = np.full(1 << self.bits, -1, np.int32)
            self._place(np.arange(self.n))
        else:
            self._place(new)
        return new

    def _place(self, left: np.ndarray) -> None:
        last = (1 << self.bits) - 1
        at = (self.keys[left] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & last


class Spelled:
    """Words one after another in ``data``, of ``size`` bytes each."""

    def __init__(self, data: np.ndarray, size: np.ndarray):
        self.data, self.size = data, size
        self.ends = np.cumsum(size)
        self.starts = self.ends - size

    def __len__(self) -> int:
        return len(self.size)

    def words(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]

    def take(self, which: np.ndarray) -> Spelled:
        return Spelled(gather(self.data, self.starts[which], self.size[which]), self.size[which])


class ChunkTable:
    """Rows of values for the distinct words met so far, worked out once for each.

    ``work`` takes new words and returns for each of them how many values it has, and all values. A word found by
    its hash is compared byte by byte; of words with equal hashes the later ones go on under further hashes. Beyond ``most``
    words or as many bytes and values by it the table gives up words, those met once since the last time first; results don't
    depend on that.
    """

    def __init__(self, work: Callable[[Spelled], tuple[np.ndarray, np.ndarray]], dtype: type, most: int = 400_000):
        self.work, self.dtype, self.most = work, dtype, most
        self._clear()

    def _clear(self) -> None:
        self.table = HashTable()
        self.pool, self.used = np.empty(1 << 14, self.dtype), 0
        self.bytes, self.filled = np.zeros(1 << 16, np.uint8), 0  # of words beyond their first eight bytes
        self.at, self.lens, self.size, self.rest = (np.empty(1 << 12, np.int32) for _ in range(4))
        self.met = np.zeros(1 << 12, np.int64)

    def _shrink(self) -> None:
        """Keep the words met most often, more than once, as far as a third of the bounds allows."""
        n, table = self.table.n, self.table
        order = np.argsort(-self.met[:n], kind="stable")
        order = order[self.met[order] > 1]
        fits = (np.cumsum(self.lens[order], dtype=np.int64) <= 8 * self.most // 3) & (np.cumsum(np.maximum(self.size[order] - 8, 0), dtype=np.int64) <= 16 * self.most // 3)
        order = np.sort(order[fits][: self.most // 3])
        h, heads, lens, size = table.keys[order], table.heads[order], self.lens[order], self.size[order]
        flat, more = gather(self.pool, self.at[order].astype(np.int64), lens.astype(np.int64)), gather(self.bytes, self.rest[order].astype(np.int64), np.maximum(size - 8, 0).astype(np.int64))
        self._clear()
        if len(order):
            self._store(h, heads, lens.astype(np.int64), flat, size.astype(np.int64), more)

    def rows(self, words: Words) -> np.ndarray:
        """The row of each word."""
        if self.table.n > self.most or self.used > 8 * self.most or self.filled > 16 * self.most:
            self._shrink()
        heads, size = words.heads, words.ends - words.starts
        out, left, h = np.empty(len(words), np.int64), np.arange(len(words)), words.hashes
        while len(left):
            got = self.table.find(h, heads[left])
            miss = np.flatnonzero(got < 0)
            if len(miss):
                order = miss[np.lexsort((heads[left[miss]], h[miss]))]
                one, two = h[order], heads[left[order]]
                first = np.ones(len(order), bool)
                first[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                got[order] = self._learn(words, left[order[first]], one[first], two[first])[np.cumsum(first) - 1]
            same = self._same(words, left, got, size[left])
            if same.all():
                out[left] = got
                break
            out[left[same]] = got[same]
            left, h = left[~same], mix64(h[~same] + M1)
        self.met[: self.table.n] += np.bincount(out, minlength=self.table.n)
        return out

    def _learn(self, words: Words, new: np.ndarray, h: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """New rows for words under these keys."""
        size = words.ends[new] - words.starts[new]
        spelled = Spelled(gather(words.texts.data, words.starts[new], size), size)
        lens, flat = self.work(spelled)
        return self._store(h, heads, lens, flat, size, gather(spelled.data, spelled.starts + 8, np.maximum(size - 8, 0)))

    def _store(self, h: np.ndarray, heads: np.ndarray, lens: np.ndarray, flat: np.ndarray, size: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Rows of these keys, values and words, of which ``more`` holds what is beyond the first eight bytes."""
        rows = self.table.add(h, heads)
        beyond = np.maximum(size - 8, 0)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while self.filled + len(more) + 8 > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        while self.table.n > len(self.at):
            self.at, self.lens, self.size, self.rest, self.met = (np.concatenate([a, np.zeros_like(a)]) for a in (self.at, self.lens, self.size, self.rest, self.met))
        self.pool[self.used : self.used + len(flat)] = flat
        self.bytes[self.filled : self.filled + len(more)] = more
        self.at[rows], self.lens[rows] = self.used + np.cumsum(lens) - lens, lens
        self.size[rows], self.rest[rows] = size, self.filled + np.cumsum(beyond) - beyond
        self.used += len(flat)
        self.filled += len(more)
        return rows

    def _same(self, words: Words, which: np.ndarray, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether each word, whose first eight bytes are those of the row, is the row's word."""
        same = self.size[rows] == size
        data = words.texts.data
        on = np.flatnonzero(same & (size > 8) & (size <= _LONG))
        for k in range(8, _LONG, 8):
            if not len(on):
                break
            left = size[on] - k
            equal = lanes(data, words.starts[which[on]] + k, left) == lanes(self.bytes, self.rest[rows[on]] + k - 8, left)
            same[on[~equal]] = False
            on = on[equal & (left > 8)]
        for i in np.flatnonzero(same & (size > _LONG)).tolist():
            at, n = self.rest[rows[i]], size[i] - 8
            same[i] = np.array_equal(data[words.ends[which[i]] - n : words.ends[which[i]]], self.bytes[at : at + n])
        return same


def gather(pool: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenated runs pool[at : at + lens]."""
    full = np.flatnonzero(lens)
    if not len(full):
        return pool[:0]
    at, lens = at[full], lens[full]
    step = np.ones(int(lens.sum()), np.int64)
    step[0] = at[0]
    step[np.cumsum(lens[:-1])] = at[1:] - (at[:-1] + lens[:-1] - 1)
    return pool[np.cumsum(step)]
