"""The relations and plans on Spark."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagegrain import streaming
from pagegrain.functions.nodeset import number
from pagegrain.functions.output import to_text
from pagegrain.functions.tree import parse
from pagegrain.operators import edit, pages
from pagegrain.plans.selectors import match_rows, parse_selector, select
from pagegrain.sources import read_files, read_pages, read_text_files

HTML = [
    "<!DOCTYPE html><ul id=m class='a b'><li>1<li class=x>2<!--c--><li>3</ul><p>t <b>u</b></p><template><p>in<b>v</b></p></template>",
    "<table><tr><td>a<td><b>c</b></table><svg><title>s</title><p>o</p>",
    "",
    None,
    "<div><div><p>1</p><span>2</span>x<p>3</p></div><a href='/q?a=1&amp;b'>l</a></div>",
]
SELECTORS = ["*", "p", "b, td", "ul > li", "li + li", "li ~ li", "div p", "div > div p", "template p b", ":not(p)", ":root", ":empty", "li:nth-child(2n+1)", "p:only-child", "[class~=b] .x", "#m li:last-child", "div ~ a[href*='a=1']", "body :first-of-type", "p b, li:first-child + li"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(HTML)), "doc_id long, html string").repartition(3).cache()


@pytest.fixture(scope="module")
def nodes(docs):
    return pages.nodes(docs).cache()


@pytest.mark.parametrize("selector", SELECTORS)
def test_plan_and_walk_agree(nodes, selector):
    expected = set()
    for i, html in enumerate(HTML):
        if html is not None:
            expected |= {(i, k) for k in match_rows(number(parse(html)[0])[1], parse_selector(selector))}
    assert {(r.doc_id, r.node_id) for r in select(nodes, selector).select("doc_id", "node_id").collect()} == expected


def test_one_pass_matches(docs):
    got = pages.matches(docs, "li, a").select("doc_id", "match", "text").orderBy("doc_id", "match").collect()
    assert [tuple(r) for r in got] == [(0, 0, "1"), (0, 1, "2"), (0, 2, "3"), (4, 0, "l")]


def test_subtree_text(nodes):
    got = {(r.doc_id, r.node_id): r.text for r in pages.subtree_text(select(nodes, "div, ul, template"), nodes).collect()}
    for (i, k), text in got.items():
        assert text == to_text(number(parse(HTML[i])[0])[0][k])
    assert len(got) == 4


def test_a_local_selector_needs_no_exchange(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumnRenamed("page_id", "doc_id")
    found = select(pages.nodes(table), "li.x:not(:empty)")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_relations(docs):
    assert [r.kind for r in pages.html_events(docs.filter("doc_id = 0")).orderBy("seq").limit(3).collect()] == ["doctype", "start", "start"]
    assert pages.tokens(docs).filter("kind = 'eof'").count() == 4
    assert {r.code for r in pages.parse_errors(docs.filter("doc_id = 1")).collect()} >= {"expected-doctype-but-got-start-tag"}
    assert pages.page_text(docs).count() == 4 and pages.page_markdown(docs).count() == 4
    assert pages.page_html(docs, pretty=False).filter("doc_id = 2").first().html == "<html><head></head><body></body></html>"
    assert pages.nodes(docs, columns=("name",)).columns == ["doc_id", "name"]


def test_bytes(spark):
    rows = spark.createDataFrame([(1, bytearray(b"<meta charset=utf-8><p>\xc3\xa9"), None), (2, bytearray(b"<p>\xe9"), None), (3, bytearray(b"\xff"), "utf-8"), (4, None, None)], "doc_id int, content binary, label string")
    got = {r.doc_id: (r.encoding, r.failed) for r in pages.decoded(rows, transport="label").collect()}
    assert got == {1: ("utf-8", False), 2: ("windows-1252", False), 3: ("utf-8", True), 4: (None, None)}
    assert {r.text for r in pages.matches(rows, "p", column="content").collect()} == {"é"}


def test_edits(docs):
    out = edit.edit_pages(docs, [edit.Edit("remove", "li:first-child"), edit.Edit("append", "ul", "<li>z"), edit.Edit("clone", "ul"), edit.Edit("replace", "p", "<i>r</i>")])
    html = {r.doc_id: r.html for r in out.collect()}
    assert html[0].count("<li>z</li>") == 2 and "<i>r</i>" in html[0] and "<li>1" not in html[0] and html[3] is None


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<meta charset=utf-8><title>\xc3\xa9</title>")
    (tmp_path / "b.txt").write_text("no")
    found = read_files(spark, str(tmp_path), "*.html")
    assert [r.text for r in pages.matches(found, "title", column="content", key="path").collect()] == ["é"]
    assert read_text_files(spark, str(tmp_path)).count() == 2


def test_streaming(spark, tmp_path):
    source = spark.createDataFrame([(i, f"http://h/{i}", f"<title>{i}</title><a href={i}>x</a>") for i in range(6)], "page_id long, url string, html string")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.stream_pages(spark, str(tmp_path / "in"), source.schema, files_per_trigger=1)
    q = streaming.write_stream(pages.matches(stream, "a[href]").select("doc_id", F.col("attrs")["href"].alias("href")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(r.href for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [str(i) for i in range(6)]


def test_partitions_do_not_matter(spark):
    p = read_pages(spark, "/root/testdata/sf0.001")
    one = sorted(json.dumps(r.asDict(), default=str) for r in pages.nodes(p.coalesce(1), columns=("node_id", "name", "data")).collect())
    many = sorted(json.dumps(r.asDict(), default=str) for r in pages.nodes(p.repartition(7), columns=("node_id", "name", "data")).collect())
    assert one == many


def test_entry(spark):
    assert entry.entry(spark).count() == 281
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_strict_parse_and_errors(spark):
    from pagegrain.functions.tree import ParseError, StrictModeError, parse

    assert parse("<!DOCTYPE html><p>x", strict=True)[1] == []
    for page, want in (("<p>x", "expected-doctype-but-got-start-tag"), ("<!DOCTYPE html><p a=1 a=>x", "(1,25): missing-attribute-value")):
        try:
            parse(page, strict=True)
        except StrictModeError as e:
            assert str(e) == want and isinstance(e.error, ParseError)
        else:
            raise AssertionError(page)


def test_commands(spark, capsys, tmp_path):
    import io

    from pagegrain.__main__ import main

    page = "<!DOCTYPE html><title>T</title><p><a href=/x>one</a> <b>two</b>"
    for args, want in ((["text"], "Tone two"), (["markdown"], "[one](/x) **two**"), (["query", "b"], "b\ttwo"), (["title"], "T"), (["links"], "/x\tone")):
        assert main(args, io.StringIO(page)) == 0
        assert capsys.readouterr().out.strip() == want
    (tmp_path / "p.html").write_text(page)
    assert main(["query", "a", str(tmp_path / "p.html")]) == 0 and capsys.readouterr().out == "a\tone\n"
    assert main(["stream"], io.StringIO("<p>x")) == 0 and capsys.readouterr().out == "start p\ntext x\n"
    assert main(["text"], io.StringIO("")) == 1
