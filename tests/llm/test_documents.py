"""Operators 2, 3, 4, 6 and 7 against brute force on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pagegrain.llm import fm_index, lm_trie, set_join, slot_shards, toxicity
from pagegrain.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=SPACED):
    return pattern.findall((text or "").translate(LOW))


# --- 2 ----------------------------------------------------------------------------------------------------------------


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((1, 5), (50, 60), (1000, 1 << 20), (5000, 1 << 44), (3000, 3100), (7, 1 << 62)):
        v = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        e = lm_trie.EliasFano(np.frombuffer(lm_trie.EliasFano.build(v), np.uint8))
        ask = np.unique(np.concatenate([v, rng.integers(0, top, 2000, dtype=np.uint64), v + np.uint64(1), np.array([0, (1 << 63) + 5], np.uint64)]))
        want = np.where(np.isin(ask, v), np.searchsorted(v, ask), -1)
        assert (e.find(ask) == want).all()
    assert lm_trie.EliasFano(np.frombuffer(lm_trie.EliasFano.build(np.empty(0, np.uint64)), np.uint8)).find(np.array([3], np.uint64)).tolist() == [-1]


def fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def test_language_model(spark, messy, messy_rows, empty, tmp_path):
    """The registered query against a model of every n-gram, those that occur once among them."""
    from pagegrain.llm.queries import op2_lm_trie

    rows = [(i, [*words(t), None]) for i, t in messy_rows]
    train = [w for i, w in rows if fold(i, 10)]
    one = collections.Counter(x for w in train for x in w)
    two = collections.Counter(x for w in train for x in zip(w, w[1:]))
    three = collections.Counter(x for w in train for x in zip(w, w[1:], w[2:]))
    assert 1 in two.values() and 1 in three.values()
    n, d = sum(one.values()), lm_trie.DISCOUNT
    types1, types2 = collections.Counter(x[0] for x in two), collections.Counter(x[:2] for x in three)
    uses1, uses2 = collections.Counter(), collections.Counter()
    for x, k in two.items():
        uses1[x[0]] += k
    for x, k in three.items():
        uses2[x[:2]] += k
    want = []
    for i, w in rows:
        score = 0.0
        for k, x in enumerate(w):
            p = (one[x] + 0.1) / (n + 0.1 * (len(one) + 1))
            if k and one[w[k - 1]]:
                a = w[k - 1]
                p = max(0, two[a, x] - d) / one[a] + (1 - (uses1[a] - d * types1[a]) / one[a]) * p
            if k > 1 and two[w[k - 2], w[k - 1]]:
                a = (w[k - 2], w[k - 1])
                p = max(0, three[*a, x] - d) / two[a] + (1 - (uses2[a] - d * types2[a]) / two[a]) * p
            score += math.log10(p)
        base = sum(math.log10((one[x] + 0.1) / (n + 0.1 * (len(one) + 1))) for x in w)
        want.append((str(i), fold(i, 10) == 0, len(w), sum(one[x] > 0 for x in w), n, base, score))
    messy.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in op2_lm_trie(spark, str(tmp_path)).collect())
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], abs=2e-3 * a[2] + 1e-6)
    assert lm_trie.score_documents(empty).count() == 0


# --- 3 ----------------------------------------------------------------------------------------------------------------


def test_suffix_array_and_index():
    rng = np.random.default_rng(5)
    s = rng.integers(0, 4, 400)
    s[-1] = 0
    gaps = np.flatnonzero(s == 0)
    key = lambda i: [(0, int(np.searchsorted(gaps, j))) if s[j] == 0 else (1, int(s[j])) for j in range(i, int(gaps[np.searchsorted(gaps, i)]) + 1)]
    assert fm_index.suffix_array(s).tolist() == sorted(range(400), key=key)
    index = fm_index.FMIndex(s, 4)
    phrases = np.array([[1, 2, 0], [3, 0, 0], [2, 2, 1], [1, 1, 1]], np.int32)
    lengths = np.array([2, 1, 3, 3])
    lo, hi = index.count(phrases, lengths)
    for p, n, a, b in zip(phrases, lengths, lo, hi, strict=True):
        want = [i for i in range(400 - n) if (s[i : i + n] == p[:n]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute_contamination(docs, bench):
    win = {}
    for item, t in bench:
        w = words(t, ALNUM)
        for k in range(max(1, len(w) - 9) if w else 0):
            win.setdefault(tuple(w[k : k + 10]), set()).add("null" if item is None else str(item))
    out = []
    for i, t in docs:
        w, hit, items = words(t, ALNUM), set(), set()
        for n in {len(k) for k in win}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in win:
                    hit.update(range(k, k + n))
                    items |= win[tuple(w[k : k + n])]
        out.append((str(i), len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_contamination(spark, messy, messy_rows, empty):
    long = messy_rows[0][1].split()
    bench = [(1, " ".join(long[5:30])), (2, "One TWO three"), (10, "one"), (3, None), (4, ""), (5, "!!! ..."), (6, "word " * 12), (None, "spaces new"), (2, "one two three"), (7, " ".join(f"zz{i}" for i in range(40)))]
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in fm_index.contamination_report(messy, b).collect())
    assert got == brute_contamination(messy_rows, bench)
    assert fm_index.contamination_report(messy, b.limit(0)).filter("contaminated").count() == 0
    assert fm_index.contamination_report(empty, b).count() == 0
    kept = fm_index.drop_contaminated(messy, b)
    assert kept.columns == messy.columns and kept.count() == sum(not x[5] for x in got)


def test_phrase_blocks_are_searched_one_by_one(spark, messy, messy_rows, monkeypatch):
    bench = [(i, t) for i, (_, t) in enumerate(messy_rows[:8])]
    monkeypatch.setattr(fm_index.write_phrases, "__defaults__", (20,))
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in fm_index.contamination_report(messy, b).collect())
    assert got == brute_contamination(messy_rows, bench)


def test_removal_spans(spark, messy_rows):
    text = "Été one, two-three four! five six seven eight nine ten eleven twelve fin"
    b = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    r = fm_index.find_contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), b).first()
    spans = [(s.start, s.end) for s in r["spans"]]
    assert fm_index.remove_spans(text, spans) == "Été one,  fin" and r["items"] == ["1"]


# --- 4 ----------------------------------------------------------------------------------------------------------------


def check_shards(rows, want):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_shards(spark, messy, messy_rows, empty):
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in messy_rows)
    check_shards(slot_shards.shard_documents(messy).collect(), want)
    rng = random.Random(2)
    many = [(i, "x" * rng.randrange(0, 400)) for i in range(3000)]
    rows = slot_shards.shard_documents(spark.createDataFrame(many, "doc_id long, text string")).collect()
    size = collections.Counter()
    for r in rows:
        size[r.shard] += r.size
    assert sorted(size) == list(range(16)) and max(size.values()) - min(size.values()) < 0.01 * max(size.values())
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert slot_shards.shard_documents(empty).count() == 0


def test_rows_that_are_repeated_are_dealt(spark):
    rows = spark.range(10_000).selectExpr("cast(5 as long) as doc_id", "'same text' as text").union(spark.range(10_000).selectExpr("id as doc_id", "'other text' as text")).repartition(7)
    got = slot_shards.shard_documents(rows).collect()
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.size
    assert len(got) == 20_000 and sorted(size) == list(range(16)) and max(size.values()) - min(size.values()) < 0.01 * max(size.values())
    for s in size:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_versions_are_stored(spark, tmp_path):
    sums = spark.createDataFrame([(i, 100 + i % 7, 1) for i in range(200)], "vslot int, bytes long, n_rows long")
    maps = slot_shards.SlotMaps(spark, str(tmp_path / "maps"))
    maps.write(slot_shards.first_map(sums, 4), 1)
    maps.rebalance(1, sums, 5)
    one, two = ({r.vslot: r.shard for r in maps.read(v).collect()} for v in (1, 2))
    assert set(one.values()) == set(range(4)) and set(two.values()) == set(range(5)) and len(two) == 200
    assert {r.version for r in maps.read(2).collect()} == {2}


def test_map_versions(spark):
    sums = spark.createDataFrame([(i, 100 + i % 7, 1) for i in range(200)], "vslot int, bytes long, n_rows long")
    one = slot_shards.first_map(sums, 4).cache()
    two = slot_shards.rebalance_map(one, sums, 5).cache()
    assert {r.version for r in one.collect()} == {1} and {r.version for r in two.collect()} == {2}
    a, b = ({r.vslot: r.shard for r in m.collect()} for m in (one, two))
    assert sorted(b) == list(range(200))
    load = collections.Counter()
    for slot, s in b.items():
        load[s] += 100 + slot % 7
    assert sorted(load) == [0, 1, 2, 3, 4] and max(load.values()) - min(load.values()) <= 220
    assert sum(a[s] != b[s] for s in a) <= 60  # about a fifth of the slots, whole
    three = {r.vslot: r.shard for r in slot_shards.rebalance_map(two, sums, 3).collect()}
    assert set(three.values()) == {0, 1, 2}


# --- 6 ----------------------------------------------------------------------------------------------------------------


def toxic_corpus(n=1500):
    rng = random.Random(11)
    syllables = ["the", "an", "er", "on", "ti", "nd", "st", "in", "ou", "es", "re", "ha"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(5, 90))]
        bad = i % 6 == 0
        if bad:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["vilething", "grubbo", "snotrag", "dreck"]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity(spark, messy, messy_rows, empty):
    docs, labels = toxic_corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None), (99_999, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_scores(d, y).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    kept = {r.doc_id for r in toxicity.drop_toxic(d, y).collect()}
    assert kept == {r.doc_id for r in rows if not r.predicted}
    assert toxicity.toxicity_scores(messy, y).count() == len(messy_rows)
    assert {r.score for r in toxicity.toxicity_scores(messy, y.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity_scores(empty, y).count() == 0
    assert toxicity.drop_toxic(messy, y).columns == messy.columns


@pytest.mark.parametrize("fit", ["chosen", "trained"])
def test_toxicity_by_brute_force(spark, messy_rows, fit):
    """Every window of every text compressed by itself, with dictionaries made anew."""
    import zstandard

    docs, labels = toxic_corpus(600)
    model = toxicity.FITS[fit]((t, y) for (i, t), (_, _, y) in zip(docs, labels, strict=True) if fold(i, 5))
    assert model.words == (1 if fit == "chosen" else toxicity.WINDOW_WORDS) and len(set(model.scores)) > 1

    def size(content, window):
        p = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False)
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p).compress(window))

    def brute(text):
        w, hits = [x.encode() for x in words(text, ALNUM)], 0
        if fit == "chosen":
            found = [toxicity.CARRIER + b" " + x + b" " + toxicity.CARRIER for x in w]
        else:
            found = [b" " + x + b" " for x in toxicity.windows(w, model.words)]
        for x in found:
            toxic, ordinary = size(model.toxic, x), size(model.ordinary, x)
            hits += ordinary - toxic >= model.gain and toxic <= model.limit
        return model.scores[min(hits, toxicity.BINS - 1)]

    texts = [t for _, t in docs[:40]] + [t for _, t in messy_rows if t is None or len(t) < 500]
    assert toxicity.scores_of(model, pa.array(texts)).tolist() == [brute(t) for t in texts]


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = toxic_corpus(600)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    one = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    two = spark.createDataFrame([(i, q, t if fold(i, 5) else 1 - t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    score = lambda y: {r.doc_id: r.score for r in toxicity.toxicity_scores(d, y).collect()}
    assert score(one) == score(two)


# --- 7 ----------------------------------------------------------------------------------------------------------------


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][0], rows[j][0]
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
    return sorted((str(i), len(s), str(None if i is None else find(i))) for (i, _), s in zip(rows, sets, strict=True))


def near_rows(seed, n=160):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(4, 140))] for _ in range(8)]
    passage = [f"common{k}" for k in range(30)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(50)}"
        if rng.random() < 0.3:
            w = w[: -rng.randrange(1, 3)] or w
        if rng.random() < 0.3:
            w += passage
        out.append((rng.randrange(10_000), " ".join(w)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("family", [1 << 12, 4 << 20])
def test_set_join(spark, seed, family):
    rows = near_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in set_join.jaccard_components(df, family=family).collect())
    assert got == brute_components(rows)


def test_large_family_of_near_copies(spark):
    """Copies that differ in a word each from their base link with it, and some only with one another."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    rows = [(5000, " ".join(base))]
    for k in range(300):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(9)}"
        rows.append((k, " ".join(w)))
    rows += [(6000 + k, rows[1][1]) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in set_join.jaccard_components(df, family=1 << 13).collect())
    assert got == brute_components(rows)


def test_rows_of_one_id_keep_the_same_row(spark):
    rows = [(1, "b c d e f"), (1, "a b c d e"), (1, None), (2, None), (2, None), (3, "x")]
    for n in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        assert sorted((r.doc_id, str(r.text)) for r in set_join.keep_one_of_each(df).collect()) == [(1, "b c d e f" if zlib.crc32(b"b c d e f") < zlib.crc32(b"a b c d e") else "a b c d e"), (2, "None"), (3, "x")]


def test_ids_are_not_broadcast(spark):
    """As many ids as a driver of 1500 MB can't hold beside the rest: no broadcast is larger than the bitmaps of their hashes."""
    docs = spark.range(1_200_000).selectExpr("if(id % 1000 = 0, null, id * 7) as doc_id", "id as bitmap", "id as _here")
    ids = spark.range(900_000).selectExpr("if(id % 100 = 0, null, id * 14) as doc_id")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "10m")
    try:
        for how in ("left_semi", "left_anti"):
            got, want = set_join.select_ids(docs, ids, how), docs.hint("merge").join(ids, "doc_id", how)
            assert got.columns == docs.columns and got.count() == want.count() and got.exceptAll(want).isEmpty()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_copies_are_dropped_without_a_broadcast_of_ids(spark):
    df = spark.createDataFrame([(k, f"a b c d e f {k // 2}") for k in range(200)] + [(7, "another one"), (None, "a b c d e f 1")], "doc_id long, text string").repartition(3)
    kept = set_join.keep_one_of_each(df)
    got = sorted(str(r.doc_id) for r in kept.collect())
    assert got == sorted([*map(str, range(0, 200, 2)), "None"])
    joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin) \[(\w+)#", kept._jdf.queryExecution().optimizedPlan().toString() + kept._jdf.queryExecution().executedPlan().toString())
    assert ("SortMergeJoin", "doc_id") in joins and ("BroadcastHashJoin", "doc_id") not in joins


def test_sets_are_written_once_for_all_copies(spark, monkeypatch):
    """Copies in many tasks, as in a corpus that is repeated with other ids: a set for each wrote several times the input to disk."""
    rows = [(100 * k + i, f"a b c d e f {i}") for k in range(12) for i in range(5)] + [(3, "another text of one id"), (900_000, "another text of one id")]
    folders = []
    monkeypatch.setattr(set_join, "drop_folder", folders.append)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in set_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(12)).collect())
    assert got == brute_components(rows)
    assert spark.read.parquet(f"{folders[0]}/sets").count() <= 7 and spark.read.parquet(f"{folders[0]}/classes").count() == 6


def test_copies_of_an_id_that_also_has_an_empty_text(spark):
    rows = [(9, "a b c d e"), (9, " "), (200, "a b c d e"), (201, " "), (9, "")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in set_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    assert got == [(9, 0, 9), (9, 0, 9), (9, 2, 9), (200, 2, 9), (201, 0, 201)]


def test_set_join_on_awkward_rows(spark, messy, messy_rows, empty):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in set_join.jaccard_components(messy).collect())
    assert got == brute_components(messy_rows)
    assert set_join.jaccard_components(empty).count() == 0
    kept = set_join.keep_one_of_each(messy)
    assert kept.columns == messy.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted([*{i for i, _, c in got if i == c and i != "None"}, "None", "None"])


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(6)
    met = 0
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        x = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.08], rng.integers(0, 1 << 62, int(rng.integers(0, 3)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if both and 100 * both >= 85 * (len(x) + len(y) - both):
            met += 1
            assert len(np.intersect1d(set_join.part_keys(x, 85), set_join.part_keys(y, 85)))
    assert met > 500


def test_local_join_derives_and_skips():
    sets = [np.unique(np.array([hash((k, x)) % (1 << 60) for x in shingles(t)], np.uint64)) for k in [0] for _, t in near_rows(4, 200)]
    join = set_join.LocalJoin(sets, np.full(len(sets), -1))
    a, b = join.links()
    assert join.derived > 0 and join.scratch > 0
    linked = collections.defaultdict(set)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if len(sets[i]) and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                linked[i].add(j)
    assert all(y in linked[max(x, y)] or x in linked[max(x, y)] for x, y in zip(a.tolist(), b.tolist(), strict=True))

    def labels(edges):
        p = list(range(len(sets)))
        for _ in range(len(sets)):
            for x, y in edges:
                p[x] = p[y] = min(p[x], p[y])
        return p

    assert labels(list(zip(a.tolist(), b.tolist(), strict=True))) == labels([(i, j) for i, js in linked.items() for j in js])


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1800)] + [(5000 + i, 5001 + i) for i in range(300)] + [(9000, 9000 + i) for i in range(1, 400)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for most in (50, 1_000_000):
        got = {r.node: r.component for r in components(df, last_edges=most).collect()}
        assert all(got.get(x, x) == find(x) for x in parent)


def test_hash_table_in_words():
    from pagegrain.llm.words import NOT_SPACE, Texts, hash_spans, runs

    t = Texts(pa.array(["Ab  c", None, "", "été x y", "z" * 300_000 + " q"]), lower=True)
    w = runs(t, NOT_SPACE)
    assert [w.word(i) for i in range(len(w))][:4] == [b"ab", b"c", "été x".encode(), b"y"] and w.counts.tolist() == [2, 0, 0, 2, 2]
    assert len(set(w.hashes.tolist())) == 6
    again = hash_spans(np.frombuffer(b"..ab c........", np.uint8), np.array([2, 5]), np.array([4, 6]))
    assert again.tolist() == w.hashes[:2].tolist()
