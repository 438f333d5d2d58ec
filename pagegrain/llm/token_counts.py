"""Token counts without the library's encoder: byte-pair merging of whole batches of pre-tokens at once.

Distinct pre-tokens are held as ragged numpy arrays of symbols. In each round every sequence merges all places of its
lowest-ranked pair at the same time (of overlapping places every second one, from the left, as one by one would give);
sequences without a known pair are done. The number of symbols that survive is the number of tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from pagegrain.llm.common import blocks, doc_texts, only
from pagegrain.llm.words import NOT_SPACE, ChunkTable, Spelled, Texts, gather, kind_cuts, runs
from pagegrain.runtime import ship_package

NO_RANK = np.int64(1 << 40)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeRules:
    """Ranks of symbol pairs and what they merge to, in an open-addressing table of numpy arrays."""

    def __init__(self, merges: list, vocab: dict[str, int], suffix: str):
        self.first = np.zeros((2, 256), np.int64)  # a byte inside a word, and at its end
        for b, c in byte_letters().items():
            self.first[:, b] = vocab[c], vocab.get(c + suffix, vocab[c])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.base = max(vocab.values()) + 1
        self.made = made
        self._build(left * self.base + right)
        born = np.full(self.base, -1)
        rank = np.arange(len(made))
        born[made[::-1]] = rank[::-1]
        if not ((born[left] < rank) & (born[right] < rank)).all():
            raise ValueError("a merge comes before the merges that make its parts")

    def _build(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NO_RANK, np.int64)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[left[free]]
            own = self.slots[at] == keys[left]
            self.ranks[at[own]] = np.minimum(self.ranks[at[own]], left[own])
            left, at = left[~own], (at[~own] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.base + b
        at = self._slot(keys)
        got = self.slots[at]
        out = np.where(got == keys, self.ranks[at], NO_RANK)
        open_ = np.flatnonzero((got != keys) & (got >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            got = self.slots[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out

    def merged_lengths(self, symbols: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Symbols that survive of each sequence; the sequences stand one after another in ``symbols``."""
        out = lens.copy()
        seq = np.flatnonzero(lens > 1)
        live = np.repeat(lens > 1, lens)
        symbols, lens = symbols[live], lens[seq]
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(lens) - 1] = True
        ranks = np.full(len(symbols), NO_RANK, np.int64)
        inner = np.flatnonzero(~last)
        ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])
        while len(seq):
            starts = np.cumsum(lens) - lens
            low = np.minimum.reduceat(ranks, starts)
            alive = low < NO_RANK
            if not alive.all():
                out[seq[~alive]] = lens[~alive]
                keep = np.repeat(alive, lens)
                symbols, ranks, last = symbols[keep], ranks[keep], last[keep]
                seq, lens, low = seq[alive], lens[alive], low[alive]
                if not len(seq):
                    break
            at = np.flatnonzero(ranks == np.repeat(low, lens))
            if len(at) > 1:
                # of places side by side, every second
                new = np.ones(len(at), bool)
                new[1:] = at[1:] != at[:-1] + 1
                run = np.flatnonzero(new)
                at = at[(np.arange(len(at)) - run[np.cumsum(new) - 1]) % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            last[at] = last[at + 1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            owner = np.repeat(np.arange(len(seq)), lens)[at]
            lens = lens - np.bincount(owner, minlength=len(seq))
            moved = at - np.arange(len(at))  # places after the gaps are closed
            symbols, ranks, last = symbols[keep], ranks[keep], last[keep]
            touched = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            ranks[touched] = NO_RANK
            touched = touched[~last[touched]]
            ranks[touched] = self.rank(symbols[touched], symbols[touched + 1])
        return out


class TokenCounter:
    """Counts tokens of a word-level byte BPE vocabulary: its own normaliser, its pattern, then the merge rounds."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        model = spec["model"]
        self.rules = MergeRules(model["merges"], model["vocab"], model["end_of_word_suffix"] or "")
        # fixed pattern of this vocabulary's pre-tokeniser, with white space spelt as the library understands it
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.splits = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.table = ChunkTable(self._count, np.int64)

    def pre_tokens(self, text: str) -> list[str]:
        return self.pattern.findall(text.lower() if text.isascii() else self.tok.normalizer.normalize_str(text))

    def _count(self, new: Spelled) -> tuple[np.ndarray, np.ndarray]:
        owner, parts, extra = [], [], np.zeros(len(new), np.int64)
        for i, raw in enumerate(new.words()):
            if raw.isalpha():  # ASCII letters alone are one pre-token
                parts.append(raw.lower())
                owner.append(i)
                continue
            text = raw.decode()
            pieces = [text]
            if "<|" in text:
                pieces = self.splits.split(text)
                extra[i] = len(pieces) - 1
            for piece in pieces:
                for p in self.pre_tokens(piece):
                    parts.append(p.encode())
                    owner.append(i)
        counts = extra
        if parts:
            lens = np.fromiter(map(len, parts), np.int64, len(parts))
            raw = np.frombuffer(b"".join(parts), np.uint8)
            symbols = self.rules.first[0][raw]
            ends = np.cumsum(lens) - 1
            symbols[ends] = self.rules.first[1][raw[ends]]
            counts = extra + np.bincount(np.array(owner), self.rules.merged_lengths(symbols, lens), len(new)).astype(np.int64)
        return np.ones(len(new), np.int64), counts

    def counts(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and tokens of each text."""
        texts = Texts(column)
        words = runs(texts, NOT_SPACE, kind_cuts(texts))
        rows = self.table.rows(words)
        each = gather(self.table.pool, self.table.at[rows], self.table.lens[rows])
        return np.diff(texts.offsets), np.diff(np.concatenate([[0], np.cumsum(each)])[words.first])


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row.

    Null and empty texts have no bytes and no tokens; repeated rows are counted each for itself; a special string
    inside a text is one token, as by the library's default. No shuffle; a task holds about 8 MB of text at a time.
    """
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = only((vocabulary, "counter"), lambda: TokenCounter(vocabulary))
        for t in blocks(batches, most=8 << 20):
            size, n = counter.counts(t["text"])
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return doc_texts(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
