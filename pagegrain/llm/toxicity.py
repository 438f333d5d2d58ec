"""Toxicity by compression distance.

Two zstandard dictionaries, one of toxic and one of ordinary text, compress each window of a document; a window counts as toxic if
the toxic dictionary saves enough bytes against the other one, and the thresholds and the score for each number of toxic windows
are calibrated on labelled rows. There are two ways to the dictionaries.

``trained``: zstandard trains each on the whole texts of its label; windows are some words in a row, those of a document
overlapping by half. This is the plain method. On labels that hang on single words it finds less than a third of the toxic
documents, since a trained dictionary holds what is frequent in both kinds of text alike.

``chosen``, the default: both dictionaries hold the same frequent words of ordinary text; the toxic one also holds the words that
toxic documents use far more often, the ordinary one as many bytes of further ordinary words in their place. A window is one word
between two halves of a carrier that stands in both dictionaries, so that a window never falls back to an uncompressed block
and its length differs by the word alone. A window counts as toxic if the toxic dictionary makes it at most ``limit`` bytes and
saves ``gain`` bytes or more. In effect this is a list of words that compression looks up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import blocks, doc_texts, only
from pagegrain.llm.words import LETTER_OR_DIGIT, ChunkTable, Texts, gather, runs
from pagegrain.runtime import ship_package

#: The most labelled rows to learn from, those with the smallest hashes of their ids.
SAMPLE_ROWS = 6000
FOLDS, COMMON_WORDS, LEVEL = 5, 2000, 9
#: A toxic word occurs in so many toxic documents and this share of them at least, and its odds are so many times those in
#: ordinary ones.
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = 5, 0.01, 20.0
CARRIER = b"@0123456789#"
BINS = 6
#: Trained dictionaries: their bytes, the lengths of their segments and of what these are told by, and words in a window.
TRAINED_BYTES, SEGMENT, SEGMENT_KEY, WINDOW_WORDS = 4096, 64, 6, 2


@dataclass(frozen=True)
class ToxicModel:
    toxic: bytes
    ordinary: bytes
    limit: int
    gain: int
    scores: tuple[float, ...]  # by the number of toxic windows, the last for more
    words: int = 1  # of a window; more than one are compressed without a carrier

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        p = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False)
        out = []
        for content in (self.toxic, self.ordinary):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
        return out


def lengths(model: ToxicModel, words: list[bytes]) -> np.ndarray:
    """Compressed lengths of each window with the toxic and the ordinary dictionary."""
    toxic, ordinary = (c.compress for c in model.compressors())
    out = np.empty((len(words), 2), np.int64)
    for i, w in enumerate(words):
        window = b"".join((CARRIER, b" ", w, b" ", CARRIER)) if model.words == 1 else b" " + w + b" "
        out[i] = len(toxic(window)), len(ordinary(window))
    return out


def document_words(text: str | None) -> list[bytes]:
    w = runs(Texts(pa.array([text or ""]), lower=True), LETTER_OR_DIGIT)
    return [w.word(i) for i in range(len(w))]


def telling_words(vocabulary: list[bytes], df: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Words that tell toxic documents, the most telling first. ``df``: documents with each word, ordinary and toxic."""
    odds = (df[1] + 0.5) / (n[1] + 1) / ((df[0] + 0.5) / (n[0] + 1))
    good = np.flatnonzero((df[1] >= max(LEAST_DOCS, LEAST_SHARE * n[1])) & (odds >= LEAST_ODDS))
    return [vocabulary[i] for i in good[np.lexsort((good, -df[1, good] * np.log(odds[good])))]]


def fit(rows: Iterator[tuple[str | None, int]]) -> ToxicModel | None:
    """The model of some (text, 0 or 1); a text that is repeated with the same label counts once. None without both labels."""
    number: dict[bytes, int] = {}
    docs: dict[tuple, np.ndarray] = {}
    for text, label in rows:
        words = Counter(document_words(text))
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        docs[hash(text), label] = np.stack([ids, np.fromiter(words.values(), np.int64, len(words))])
    labels = np.array([y for _, y in docs], np.int64)
    found = list(docs.values())
    n = np.array([(labels == 0).sum(), (labels == 1).sum()])
    if not n.all():
        return None
    vocabulary = list(number)
    df = np.zeros((2, len(vocabulary)))
    for y, (ids, _) in zip(labels, found, strict=True):
        df[y, ids] += 1
    telling = telling_words(vocabulary, df, n)
    frequent = [vocabulary[i] for i in np.lexsort((np.arange(len(vocabulary)), -df[0])) if df[0, i]]
    insult = b"".join(b" " + w for w in telling)
    fill = b""
    for w in frequent[COMMON_WORDS:]:
        if len(fill) + len(w) < len(insult):
            fill += b" " + w
    common = b" " + b" ".join(frequent[:COMMON_WORDS][::-1]) + b" " + CARRIER + CARRIER
    model = ToxicModel(insult + common, fill.ljust(len(insult)) + common, 0, 0, ())
    size = lengths(model, vocabulary)
    saved, tried = size[:, 1] - size[:, 0], []
    for gain in range(1, 9):
        for limit in sorted({*np.unique(size[saved >= gain, 0])[:4].tolist(), int(size[:, 0].max())}):
            flag = (saved >= gain) & (size[:, 0] <= limit)
            hits = np.array([int(counts[flag[ids]].sum()) for ids, counts in found])
            right = max(int(((hits >= k) == (labels == 1)).sum()) for k in (1, 2, 3))
            tried.append((right, int(flag.sum()), gain, limit, hits))
    most = max(t[0] for t in tried)
    slack = np.sqrt(max(1, len(labels) - most)) / 8
    if not telling:
        return ToxicModel(model.toxic, model.ordinary, -1, 1, (float(n[1] / n.sum()),) * BINS)
    # of thresholds that are as good, within the error of their figure, those that flag the fewest words
    _, _, gain, limit, hits = min((t for t in tried if t[0] >= most - slack), key=lambda t: (t[1], t[2], t[3]))
    return ToxicModel(model.toxic, model.ordinary, limit, gain, _calibrated(hits, labels))


def fit_trained(rows: Iterator[tuple[str | None, int]], words: int = WINDOW_WORDS, size: int = TRAINED_BYTES) -> ToxicModel | None:
    """The model of dictionaries that zstandard trains on the texts of each label; None without enough text of both."""
    texts: dict[tuple[bytes, int], None] = {}
    for text, label in rows:
        texts[b" ".join(document_words(text)), label] = None
    labels = np.array([y for _, y in texts], np.int64)
    parts = []
    for y in (1, 0):
        samples = [b" " + t + b" " for t, label in texts if label == y and t]
        try:
            parts.append(zstandard.train_dictionary(size, samples, k=SEGMENT, d=SEGMENT_KEY, level=LEVEL).as_bytes())
        except zstandard.ZstdError:  # too little text
            return None
    model = ToxicModel(parts[0], parts[1], 1 << 30, 0, (), words)
    sizes = [lengths(model, windows(t.split(b" "), words)) for t, _ in texts]
    saved = [x[:, 1] - x[:, 0] for x in sizes]
    tried = []
    for gain in range(1, 9):
        hits = np.array([int((x >= gain).sum()) for x in saved])
        tried.append((max(int(((hits >= k) == (labels == 1)).sum()) for k in range(1, BINS)), -gain, hits))
    _, gain, hits = max(tried, key=lambda t: t[:2])
    return ToxicModel(parts[0], parts[1], 1 << 30, -gain, _calibrated(hits, labels), words)


def windows(words: list[bytes], n: int) -> list[bytes]:
    """All runs of n words that begin half a run apart, the last one whatever is left; a shorter text is one window."""
    if n == 1:
        return words
    step = max(1, n // 2)
    return [b" ".join(words[k : k + n]) for k in range(0, max(1, len(words) - n + step), step)] if words and words != [b""] else []


def _calibrated(hits: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """The share of toxic documents by the number of toxic windows, drawn a little towards the whole; it never falls."""
    scores, low, share = [], 0.0, float(labels.mean())
    for k in range(BINS):
        some = hits == k if k < BINS - 1 else hits >= k
        low = max(low, float((labels[some].sum() + share) / (some.sum() + 1)))
        scores.append(min(low, 1.0))
    return tuple(scores)


def fold(doc_id: str = "doc_id", folds: int = FOLDS) -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


#: The ways to the dictionaries.
FITS = {"chosen": fit, "trained": fit_trained}


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, dictionaries: str = "chosen") -> ToxicModel | None:
    """Learn from at most ``rows`` labelled rows outside fold 0. Rows are fetched one after another, never held at once.

    A document with labels of both kinds counts as toxic.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(fold() != 0)
    sample = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    joined = doc_texts(docs).join(F.broadcast(sample), "doc_id").select("text", "toxic")
    return FITS[dictionaries]((r.text, r.toxic) for r in joined.toLocalIterator())


def toxic_windows(model: ToxicModel, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """How many windows of each text are toxic; all windows are looked at, where they are words each distinct one once."""

    def work(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = lengths(model, new)
        return np.ones(len(new), np.int64), (size[:, 1] - size[:, 0] >= model.gain) & (size[:, 0] <= model.limit)

    words = runs(Texts(column, lower=True), LETTER_OR_DIGIT)
    if model.words > 1:
        first = words.first.tolist()
        return np.array([int(work(windows([words.word(i) for i in range(a, b)], model.words))[1].sum()) for a, b in zip(first[:-1], first[1:], strict=True)], np.int64)
    t = only(model, lambda: ChunkTable(lambda new: work(new.words()), bool))
    rows = t.rows(words)
    each = gather(t.pool, t.at[rows], t.lens[rows]).astype(np.int64)
    return np.diff(np.concatenate([[0], np.cumsum(each)])[words.first])


def scores_of(model: ToxicModel | None, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Scores from 0 to 1; without a model all are 0."""
    if model is None:
        return np.zeros(len(column))
    return np.array(model.scores)[np.minimum(toxic_windows(model, column), BINS - 1)]


def toxicity_scores(docs: DataFrame, labels: DataFrame, dictionaries: str = "chosen") -> DataFrame:
    """doc_id, held_out, score and predicted of each row.

    Null and empty texts have no toxic window and the score of such texts. Without labelled rows of both kinds every score is 0.
    Repeated rows are scored each and alike; equal scores are ties that nothing breaks. A very long text is scored whole. Only
    texts are inputs of a score; columns besides doc_id and text are ignored whatever their names. An empty table gives an empty
    result. No shuffle.
    """
    ship_package(docs.sparkSession)
    model = train(docs, labels, dictionaries=dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches, most=2 << 20):
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), pa.array(scores_of(model, t["text"]))], names=["doc_id", "score"])

    scored = doc_texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, with a score below one half.

    Null and empty texts have no toxic window and stay, rows without an id are judged by their text; repeated rows go or stay
    alike; without labelled rows of both kinds all stay.
    """
    ship_package(docs.sparkSession)
    model = train(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches, most=1 << 20):
            yield from t.filter(pa.array(scores_of(model, t["text"].cast(pa.string())) < 0.5)).to_batches()

    return docs.mapInArrow(keep, docs.schema)
