"""Whole-text token ids of a public tokenizer, by encoding each distinct chunk of text once.

Both vocabularies split a text into pre-tokens before merging, and no pre-token crosses the borders used here.
So the ids of a text are the ids of its chunks in turn, and the library has to encode a chunk only when it is new.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from pagegrain.llm.common import only
from pagegrain.llm.words import NOT_SPACE, ChunkTable, Spelled, Texts, gather, kind_cuts, runs, space_chunks

_CODES = np.arange(256)
_LETTER = ((_CODES >= 0x41) & (_CODES <= 0x5A)) | ((_CODES >= 0x61) & (_CODES <= 0x7A))


class ChunkEncoder:
    """Encodes texts with the tokenizers library (add_special_tokens=False).

    ``spaces``: "dropped" where the vocabulary drops white space (chunks are the runs without ASCII white space),
    "joined" where a space belongs to the word after it (chunks begin at single spaces).
    """

    def __init__(self, path: str, spaces: str):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        if hasattr(self.tok.model, "_resize_cache"):
            self.tok.model._resize_cache(0)  # chunks are encoded once; the library keeps the caches of vocabularies that are gone
        self.joined, self.border = spaces == "joined", np.empty(0, bool)
        self.table = ChunkTable(self._encode, np.uint32, most=120_000)

    def _each(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all ids."""
        ids = [e.ids for e in self.tok.encode_batch_fast(new, add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return lens, np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum()))

    def _plain(self, new: Spelled) -> np.ndarray:
        """Whether each chunk is one pre-token whose border shows in its ids, also with others of the kind beside it."""
        wide = np.add.reduceat(new.data >= 0x80, new.starts, dtype=np.int64)
        letters = np.add.reduceat(_LETTER[new.data], new.starts, dtype=np.int64)
        plain = letters + wide + self.joined == new.size
        if self.joined:
            plain &= (new.data[new.starts] == 0x20) & (new.size > 1)
        some = np.flatnonzero(plain & (wide > 0))
        if len(some):
            text = [w.decode() for w in new.take(some).words()]
            plain[some] = [w[1:].isalpha() for w in text] if self.joined else [w.isalpha() and max(w) < "\u0130" for w in text]
        return plain

    def _encode(self, new: Spelled) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each chunk has, and all ids. Plain chunks go to the library forty at a time."""
        if not self.border.size:
            vocab = self.tok.get_vocab()
            self.border = np.zeros(max(vocab.values()) + 1, bool)
            self.border[[i for t, i in vocab.items() if (t[0] == "Ġ" if self.joined else t.endswith("</w>"))]] = True
        is_plain = self._plain(new)
        plain, rest = np.flatnonzero(is_plain), [np.flatnonzero(~is_plain)]
        done, lens, flat = [], [], []
        for k in range(0, len(plain), 4000):  # the library's results are large
            some = plain[k : k + 4000]
            whole, counts, ids = self._glued(new.take(some))
            done.append(some[whole])
            rest.append(some[~whole])
            lens.append(counts)
            flat.append(ids)
        left = np.concatenate(rest)
        for k in range(0, len(left), 4000):
            some = left[k : k + 4000]
            counts, ids = self._each([w.decode() for w in new.take(some).words()])
            done.append(some)
            lens.append(counts)
            flat.append(ids)
        order, counts = np.concatenate(done), np.concatenate(lens)
        at, out = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        at[order], out[order] = np.cumsum(counts) - counts, counts
        return out, gather(np.concatenate(flat), at, out)

    def _glued(self, new: Spelled) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Plain chunks encoded forty together: for which of them the ids show the borders, how many ids each of those has, and these ids."""
        gap = 0 if self.joined else 1
        raw = (np.insert(new.data, new.ends, 0x20) if gap else new.data).tobytes()
        first = np.arange(0, len(new), 40)
        size = np.diff(np.append(first, len(new)))
        begin, end = new.starts[first] + gap * first, new.ends[first + size - 1] + gap * (first + size - 1)
        lens, ids = self._each([raw[a:b].decode() for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
        mark = self.border[ids]
        ends, seen = np.cumsum(lens), np.concatenate([[0], np.cumsum(mark)])
        good = (lens > 0) & (seen[ends] - seen[ends - lens] == size)
        good[good] &= mark[(ends - lens if self.joined else ends - 1)[good]]
        keep = np.repeat(good, lens)
        ids, at = ids[keep], np.flatnonzero(mark[keep])
        borders = np.append(at, len(ids)) if self.joined else np.append(0, at + 1)
        return np.repeat(good, size), np.diff(borders), ids

    def encode(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and the border of each text; null counts as empty."""
        texts = Texts(column)
        cut = kind_cuts(texts)
        words = space_chunks(texts, cut) if self.joined else runs(texts, NOT_SPACE, cut)
        rows = self.table.rows(words)
        lens = self.table.lens[rows]
        ids = gather(self.table.pool, self.table.at[rows], lens)
        return ids, np.concatenate([[0], np.cumsum(lens)])[words.first]


def encoder(path: str, spaces: str) -> ChunkEncoder:
    """One encoder for a vocabulary and Python worker."""
    return only((path, spaces), lambda: ChunkEncoder(path, spaces))


def crc_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
