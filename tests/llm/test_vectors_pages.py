"""Operators 5 and 8, the pipeline, and the queries' registration."""

import gc
import json
import random
import weakref

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pagegrain.llm import common, host_suffix, lattice, set_join
from pagegrain.llm.tokens import encoder
from tests.llm.test_documents import brute_contamination

SF = "/root/testdata/sf0.001"


# --- 8 ----------------------------------------------------------------------------------------------------------------


def brute_links(rows, least=0.93):
    ok = []
    for i, v, label in rows:
        good = i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append(np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if good else None)
    links = [[j for j in range(len(rows)) if j != i and ok[i] is not None and ok[j] is not None and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= least] for i in range(len(rows))]
    label = {r[0]: r[0] for r in rows}
    for _ in range(len(rows)):
        for i, js in enumerate(links):
            for j in js:
                a, b = rows[i][0], rows[j][0]
                label[a] = label[b] = min(label[a], label[b])
    return links, label


def vectors(seed, n=400, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    out = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.standard_normal(dim) * rng.choice([0.05, 0.15, 0.3, 2.0])
        out.append((int(i * 7 % 1000), [float(np.float32(x)) for x in v], int(rng.integers(2))))
    return out


def test_lattice_points():
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, (300, 8))
    p = lattice.nearest_e8(x)
    twice = np.rint(2 * p)
    assert (np.abs(2 * p - twice) < 1e-9).all() and (twice.sum(axis=1) % 4 == 0).all() and ((twice % 2 == twice[:, :1] % 2).all(axis=1)).all()
    assert ((x - p) ** 2).sum(axis=1).max() <= 1 + 1e-9  # the covering radius
    for v in lattice.NEIGHBOURS:
        assert (((x - p) ** 2).sum(axis=1) <= ((x - p - v) ** 2).sum(axis=1) + 1e-9).all()
    assert len(lattice.NEIGHBOURS) == 240 and np.allclose((lattice.NEIGHBOURS**2).sum(axis=1), 2)


@pytest.mark.parametrize("options", [o for _, o in lattice.SETTINGS])
def test_recall_against_brute_force(options):
    """Pairs at the threshold itself, where the recall is least."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((1500, 64))
    y -= (y * x).sum(axis=1)[:, None] * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1)[:, None]
    t = lattice.E8Tables(64, *options)
    (ox, px), (oy, py) = t.cells(x, np.zeros(1500, np.int64)), t.cells(y, np.zeros(1500, np.int64))
    met = (ox == oy) | (px == oy[:, :, None]).any(axis=2) | (py == ox[:, :, None]).any(axis=2)
    assert met.any(axis=1).mean() > 0.98


@pytest.mark.parametrize("cell_rows", [40, 2048])
def test_near_vectors(spark, cell_rows):
    rows = vectors(1)
    links, label = brute_links(rows)
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "vec_id long, embedding array<float>, label int, cell string, rep int").repartition(4)
    got = {r.vec_id: r for r in lattice.near_vectors(df, cell_rows=cell_rows).collect()}
    want = sum(map(len, links))
    assert 0.97 * want <= sum(r.n_links for r in got.values()) <= want
    assert all(got[r[0]].n_links <= len(js) for r, js in zip(rows, links, strict=True))
    assert np.mean([got[i].component_id == c for i, c in label.items()]) > 0.97


@pytest.mark.parametrize("small", [0, 10_000])
def test_cells_as_lists_and_as_matrices(spark, monkeypatch, small):
    monkeypatch.setattr(lattice, "SMALL", small)
    rows = vectors(3, 300)
    links, label = brute_links(rows)
    cells = lattice.E8Tables(16, 2, 8, 6, 2.0)  # so large that nothing is missed
    raw = [(np.array(v) / np.linalg.norm(v)) for _, v, _ in rows]
    own, near = cells.cells(np.array(raw), np.array([r[2] for r in rows]))
    t = pa.table({
        "cell": np.concatenate([own[:, :, None], near], axis=2).reshape(len(rows), -1).ravel().view(np.int64),
        "rep": np.repeat([1000 + i for i in range(len(rows))], 8 * 13),
        "own": np.tile(np.arange(8 * 13) % 13 == 0, len(rows)),
        "side": np.full(len(rows) * 8 * 13, -1),
        "n": np.ones(len(rows) * 8 * 13, np.int64),
        "label": np.repeat([r[2] for r in rows], 8 * 13),
        "vector": pa.array([v.tobytes() for v in raw for _ in range(8 * 13)], pa.binary()),
    })
    got = lattice._compare(t, 0.93, (2, 8, 6, 2.0)).to_pylist()
    assert {r["rep"]: r["links"] for r in got if r["rep"] is not None} == {1000 + i: len(js) for i, js in enumerate(links) if js}


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1), (3, [1.0, 2.0], 1), (4, [1.0, 2.0], 2), (5, [1.0, 2.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [], 1), (12, [1.0, 2.0, 0.0], 1), (13, [-1.0, -2.0], 1), (14, [1e-30, 2e-30], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(df).collect()}
    assert {i: got[i] for i in (1, 2, 3, 14)} == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 14: (3, 1, False)}
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13))
    assert lattice.near_vectors(df.limit(0)).count() == 0


def test_links_do_not_depend_on_the_number_of_rows(spark, monkeypatch):
    """Near vectors alone and among many others; a second setting that finds nothing must not come into use."""
    monkeypatch.setattr(lattice, "SETTINGS", ((50, lattice.SETTINGS[0][1]), (1 << 62, (2, 1, 1, 0.001))))
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(16)
    near = [(k, (centre + 0.05 * rng.standard_normal(16)).tolist(), 1) for k in range(12)]
    far = [(100 + k, rng.standard_normal(16).tolist(), 2) for k in range(200)]
    found = []
    for rows in (near, near + far):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        found.append({r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(df).collect() if r.vec_id < 100})
    assert found[0] == found[1] and sum(n for n, _, _ in found[0].values()) > 100


def test_many_equal_vectors(spark):
    df = spark.range(500).selectExpr("id as vec_id", "array(cast(1 as float), cast(id % 2 as float)) as embedding", "1 as label")
    got = lattice.near_vectors(df).collect()
    assert {r.n_links for r in got} == {249} and {r.component_id for r in got} == {0, 1}


# --- 5 ----------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body class="nav-open">
<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use</div><div id=ad class=ad>Buy</div>
<article><header><h2>Head&shy;line &amp; more</h2></header><p>One <b>b</b>old &eacute;<br>two<p>three&nbsp;x <a href="a>b">link</a><form>f<input></form><aside>side</aside>
<ul><li>i1<li>i2</ul><!-- c --><section class="comments"><p>me too</p></section><figure><figcaption>cap</figcaption></figure></article>
<footer>&copy; foot</footer></body></html>"""


def test_main_text():
    assert host_suffix.settled_text(PAGE) == "Head­line & more One bold é two three x link i1 i2 cap"
    assert host_suffix.settled_text("<article><p>cut of") == "cut of"
    assert host_suffix.settled_text("<div role=main>a</div><div>b</div>") == "a"
    assert host_suffix.settled_text("") == host_suffix.settled_text(None) == ""
    assert host_suffix.settled_text("<article>a < b &lt; c<br/>d</article>") == "a < b < c d"


def test_elements_around_the_article_stay():
    for page in (
        "<div class='site has-sidebar'><article>y</article></div>",
        "<div class='page nav-fixed'><main>y</main></div>",
        "<nav><ul><li>x<article>y</article></ul></nav>",
        "<form id=f><article>y</article><input></form>",
        "<body class=nav><div class='sidebar'><div><article>y",
        "<aside><article>teaser</article></aside><div class=wrapper><main><p>y</main></div>",
    ):
        assert host_suffix.settled_text(page) == "y", page
    assert host_suffix.settled_text("<article><p id='banner-history'>a<p class=notice>no</p><section id=share-prices>b</section></article>") == "a b"
    assert host_suffix.settled_text("<article>a<section class=comments><article>no</article></section></article>") == "a"
    assert host_suffix.settled_text("<script>'<article>'</script><p>a") == "a"


def test_long_and_repeated_pages(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "http://h/1", f"<nav>x</nav><article><p>{long}</article>")] * 2 + [(2, "http://h/2", f"<p>{long}</p>")] * 2 + [(3, "http://h/3", "<div>" * 3000 + "deep")]
    got = host_suffix.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), bucket=1000).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted([(1, long), (1, long), (2, long), (2, long), (3, "deep")])


def test_anchors_inside_an_article_are_text():
    page = "<article><h2 id=related-work>Related</h2><section id='search-results'>a</section><p data-id=ad data-role='menu'>b</p><div id=comments>no</div><div class='share-bar'>no</div></article>"
    assert host_suffix.settled_text(page) == "Related a b"
    assert host_suffix.settled_text("<div id=ad-top>no</div><p data-id=ad>yes") == "yes"


def test_repeated_substrings():
    rng = random.Random(1)
    shared = [f"s{i}" for i in range(12)]
    pages = [[[f"u{rng.randrange(10**6)}" for _ in range(20)] + shared + ["tail"], shared[:5]] for _ in range(5)]
    hits = host_suffix.repeated(pages)
    for blocks, marks in zip(pages, hits, strict=True):
        assert [w for w, h in zip(blocks[0], marks[0], strict=True) if h] == [*shared, "tail"]
        assert not marks[1].any()
    # twice on one page isn't boilerplate
    assert not any(m.any() for marks in host_suffix.repeated([[shared, shared], [["x"]]]) for m in marks)
    assert [len(blocks) for blocks in host_suffix.repeated([[], [[]]])] == [0, 1]


def test_main_text_on_spark(spark):
    boiler = " ".join(f"menu{i}" for i in range(15))
    rows = [(i, f"http://h{i % 2}.x/{i}", f"<div>{boiler}</div><div>own text number {i} with words w{i}</div>") for i in range(40)]
    rows += [(100, "http://h0.x/a", PAGE), (101, None, None), (102, "http://h0.x", ""), (103, "bad url", "<p>plain"), (None, None, "<main>m</main>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    for bucket in (300, 4 << 20):
        got = {r.page_id: (r.url, r.text, r.n_chars) for r in host_suffix.main_text(df, bucket=bucket).collect()}
        assert len(got) == len(rows)
        assert all(got[i][1] == f"own text number {i} with words w{i}" and got[i][2] == len(got[i][1]) for i in range(40))
        assert got[101] == (None, "", 0) and got[102][1] == "" and got[103][1] == "plain" and got[None][1] == "m"
    assert host_suffix.main_text(df.limit(0)).count() == 0


def test_boilerplate_is_counted_over_the_whole_host(spark):
    notice = " ".join(f"notice{i}" for i in range(12))
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(10))
    rows = [(i, f"http://h.x/{i}", f"<p>{text(i)}</p>" + (f"<p>{notice}</p>" if i % 60 == 0 else "")) for i in range(240)]
    rows += [(1000 + i, f"http://two.x/{i}", f"<p>{text(1000 + i)}</p>" + (f"<p>{notice}</p>" if i < 2 else "")) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = {i: text(i) + (f" {notice}" if i in (1000, 1001) else "") for i, _, _ in rows}
    for bucket in (300, 4 << 20):
        assert {r.page_id: r.text for r in host_suffix.main_text(df, bucket=bucket).collect()} == want


def test_copies_are_one_page(spark):
    own, notice = ([f"{x}{i}" for i in range(12)] for x in "ab")
    marks = host_suffix.repeated([[own], [own], [own], [own, ["end"]]])
    assert not any(m.any() for page in marks for m in page)
    rows = [(1, "http://h.x/1")] * 3 + [(2, "http://h.x/2"), (3, "http://h.x/3"), (4, "http://other.x/1")]
    rows = [(*r, f"<p>{' '.join(own)}</p>") for r in rows]
    # on two distinct pages, one of them in many copies, then on three
    for host, least in (("two", 2), ("three", 3)):
        rows += [(10, f"http://{host}.x/{i % 7}", f"<p>{' '.join(notice)}</p><p>copied</p>") for i in range(50)]
        rows += [(10 + i, f"http://{host}.x/{i}", f"<p>{' '.join(notice)}</p><p>page {i}</p>") for i in range(1, least)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for bucket in (1, 4 << 20):
        got = host_suffix.main_text(df, bucket=bucket).collect()
        assert sorted((r.page_id, r.url) for r in got) == sorted(r[:2] for r in rows)
        for r in got:
            tail = "copied" if r.page_id == 10 else f"page {r.page_id - 10}"
            assert r.text == (" ".join(own) if r.page_id < 10 else tail if "three" in r.url else " ".join([*notice, tail]))


# --- the pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
        if name != "packing":
            assert seen[-1].columns == docs.columns
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    assert ids[0] >= ids[1] > ids[2] > ids[3] and ids[4] == ids[3]
    # every text that stays is whole
    assert seen[3].join(docs, docs.columns, "left_semi").count() == len(ids[3])
    # each stage by brute force on what it was given
    from tests.llm.test_documents import brute_components

    given = [(r.doc_id, r.text) for r in seen[1].collect()]
    assert ids[2] == {int(i) for i, _, c in brute_components(given) if i == c}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = brute_contamination([(r.doc_id, r.text) for r in seen[2].collect()], bench)
    assert ids[3] == {int(x[0]) for x in clean if not x[5]}
    assert corpus_pipeline.run(spark, SF).count() == seen[4].count()


def test_registration():
    names = list(entry.queries())
    assert [sum(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert json.dumps(entry.oracle_sql())


def test_pipeline_bounds_batches_by_bytes(spark):
    """Whichever stage comes first, texts reach workers some megabytes at a time, and a limit that the session has stays."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 600) as text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([b.nbytes], pa.int64())})

    def largest():
        return max(r.bytes for r in docs.mapInArrow(sizes, "bytes long").collect())

    before = spark.conf.get(limit, None)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(limit)
            assert largest() > 8 << 20
            stage(spark, docs.limit(3), SF)
            assert largest() < 3 << 20
        spark.conf.set(limit, "5m")
        corpus_pipeline.packing(spark, docs.limit(3), SF)
        assert spark.conf.get(limit) == "5m"
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)


def test_dropped_encoder_is_freed():
    """Workers live on, and an encoder that another operator replaces is gone at once, not at some later collection."""
    made = weakref.ref(encoder(public_tokenizers.path("byte_bpe_50k.json"), "joined"))
    assert made() is not None
    gc.collect()
    gc.disable()
    try:
        common.only("another operator", list)
        assert made() is None
    finally:
        gc.enable()


def test_set_join_drops_what_another_operator_kept():
    common.only(("a vocabulary", "joined"), lambda: [0] * 1000)
    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": ["a b c d e", "a b c d e"]})
    found = next(set_join._hash_rows(iter([rows])))
    assert found["head"].to_pylist() == [1, 1] and not common._KEPT
