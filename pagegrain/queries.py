"""Queries over the page table, one or more for each operator, and SQL of the same meaning where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain import cases
from pagegrain.functions.register import register, resolve_url
from pagegrain.operators import edit, pages
from pagegrain.plans.selectors import SELECTOR_COLUMNS, select, selector_condition
from pagegrain.sources import read_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _unescape(x: str) -> str:
    """Of the references that the pages hold, in SQL; the ampersand last."""
    return f"replace(replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', chr(169)), '&middot;', chr(183)), '&lt;', '<'), '&amp;', '&')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _nodes(spark: SparkSession, d: str, *columns: str, where: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The nodes of all pages, or those that match a selector."""
    return pages.nodes(read_pages(spark, d), columns=columns or tuple(pages.NODES), where=where, keep=keep)


def _with_nulls(texts: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Relations have no rows for nulls; a null has a null text here."""
    return texts.union(df.filter(F.col(column).isNull()).select("doc_id", F.lit(None).cast("string").alias("text")))


#: Links of a page, numbered, from its text; the pages hold no other elements with href.
LINKS = "select page_id as doc_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as href from pages"


@query(f"select doc_id, {_unescape('href')} as href from ({LINKS})")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, "attrs", where="a[href]").select("doc_id", F.col("attrs")["href"].alias("href"))


@query(f"select page_id as doc_id, {_unescape('x[1]')} as href, {_squeeze(_unescape('x[2]'))} as text from (select page_id, unnest(list_zip(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1), regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2))) as x from pages)")
def link_texts(spark: SparkSession, d: str) -> DataFrame:
    return pages.matches(read_pages(spark, d), "nav a[href]").select("doc_id", F.col("attrs")["href"].alias("href"), "text")


@query(f"select page_id as doc_id, {_squeeze(_unescape("regexp_extract(html, '<title>([^<]*)', 1)"))} as title from pages")
def page_title(spark: SparkSession, d: str) -> DataFrame:
    return pages.matches(read_pages(spark, d), "title", first=True).select("doc_id", F.col("text").alias("title"))


@query("select page_id as doc_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) as lang from pages")
def page_lang(spark: SparkSession, d: str) -> DataFrame:
    return select(_nodes(spark, d, "kind", "name", "attrs", "parent_name"), "html:root[lang]").select("doc_id", F.col("attrs")["lang"].alias("lang"))


@query("select page_id as doc_id, regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) as charset from pages")
def meta_charset(spark: SparkSession, d: str) -> DataFrame:
    return select(_nodes(spark, d, "kind", "name", "attrs"), "meta[charset]").select("doc_id", F.col("attrs")["charset"].alias("charset"))


@query("select page_id as doc_id, 'html' as doctype, false as force_quirks from pages where html ilike '<!doctype html>%'")
def page_doctype(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, "kind", "doctype").filter("kind = 'doctype'").select("doc_id", F.col("doctype.name").alias("doctype"), "doctype.force_quirks")


@query("select page_id as doc_id, unnest(regexp_extract_all(html, '<!--(.*?)-->', 1)) as comment from pages")
def page_comments(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, "kind", "data").filter("kind = 'comment'").select("doc_id", F.col("data").alias("comment"))


LI = "select page_id as doc_id, regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1) as li from pages"


@query(f"select doc_id, n, {_squeeze(_unescape('li[n]'))} as text from ({LI}), (values (3), (6)) as v(n) where len(li) >= n")
def nav_item_nth(spark: SparkSession, d: str) -> DataFrame:
    return pages.matches(read_pages(spark, d), "nav > ul > li:nth-child(3n)", extra=("elem_idx",)).select("doc_id", F.col("elem_idx").alias("n"), "text")


@query(f"select doc_id, n, {_squeeze(_unescape('li[n]'))} as text from ({LI}), (values (3), (6)) as v(n) where len(li) >= n")
def nav_item_nth_plan(spark: SparkSession, d: str) -> DataFrame:
    """The same over the nodes relation, with the texts of the matches from their intervals."""
    nodes = _nodes(spark, d, *SELECTOR_COLUMNS, "data")
    items = select(nodes, "nav > ul > li:nth-child(3n)")
    return pages.subtree_text(items, nodes, carry=("elem_idx",)).select("doc_id", F.col("elem_idx").alias("n"), "text")


@query(f"select doc_id, 'first' as which, {_squeeze(_unescape('li[1]'))} as text from ({LI}) where len(li) > 0 union all select doc_id, 'last', {_squeeze(_unescape('li[-1]'))} from ({LI}) where len(li) > 0")
def first_last_li(spark: SparkSession, d: str) -> DataFrame:
    found = pages.matches(read_pages(spark, d), "ul li:first-child, ul li:last-child", extra=("elem_idx", "elem_cnt"))
    which = F.array_compact(F.array(F.when(F.col("elem_idx") == 1, F.lit("first")), F.when(F.col("elem_idx") == F.col("elem_cnt"), F.lit("last"))))
    return found.select("doc_id", F.explode(which).alias("which"), "text")


@query(f"select page_id as doc_id, {_squeeze(_unescape("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)"))} as text from pages")
def ad_text(spark: SparkSession, d: str) -> DataFrame:
    return pages.matches(read_pages(spark, d), "div.ad").select("doc_id", "text")


@query(f"select page_id as doc_id, {_squeeze(_unescape("regexp_extract(html, '<h1>([^<]*)', 1)"))} as text from pages where html like '%<h1>%'")
def h1_text(spark: SparkSession, d: str) -> DataFrame:
    return pages.matches(read_pages(spark, d), "article > h1").select("doc_id", "text")


#: A page without the text of its script and style.
BARE = "select page_id, regexp_replace(regexp_replace(html, '<script>.*?</script>', '<script></script>', 'g'), '<style>[^<]*', '<style>', 'g') as h from pages"

@query(f"select name, count(*) as n from (select unnest(regexp_extract_all(h, '<([a-z][a-z0-9]*)[ >]', 1)) as name from ({BARE})) group by name")
def start_tokens_by_name(spark: SparkSession, d: str) -> DataFrame:
    return pages.tokens(read_pages(spark, d)).filter("kind = 'start'").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


#: In a tree a b that its paragraph's end closes goes on in the next paragraphs, so b elements outnumber their tags.
@query(f"select name, count(*) as n from (select unnest(regexp_extract_all(h, '<([a-z][a-z0-9]*)[ >]', 1)) as name from ({BARE})) where name <> 'b' group by name")
def element_counts(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, "name", where=":not(:root):not(b), html").filter("name not like '#%' and name <> '!doctype'").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


#: A page cut at its tags.
PIECES = f"select unnest(regexp_split_to_array(regexp_replace(h, '<[^<>]*>?', chr(1), 'g'), chr(1))) as piece from ({BARE})"


@query(f"select kind, sum(n)::bigint as n from (select 'comment' as kind, len(regexp_extract_all(h, '<!--')) as n from ({BARE}) union all select 'doctype', len(regexp_extract_all(h, '(?i)<!doctype')) from ({BARE}) union all select 'start', len(regexp_extract_all(h, '<[a-z][a-z0-9]*[ >]')) from ({BARE}) union all select 'end', len(regexp_extract_all(h, '</[a-z][a-z0-9]*>')) from ({BARE}) union all select 'text', count(*) from ({PIECES}) where piece <> '' union all select 'text', len(regexp_extract_all(html, '<script>[^<]')) from pages union all select 'text', len(regexp_extract_all(html, '<style>[^<]')) from pages) group by kind")
def events_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return pages.html_events(read_pages(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"select regexp_extract(url, '^[a-z]+://([^/]*)', 1) as host, sum(len(regexp_extract_all(html, '<a href=\"')))::bigint as links, count(*) as pages from pages group by 1")
def links_per_host(spark: SparkSession, d: str) -> DataFrame:
    links = pages.match_counts(read_pages(spark, d), {"n": "a[href]"}, keep=("url",))
    return links.groupBy(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host")).agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("pages"))


#: The text of a page: script and style are text too, so their tags alone go.
PLAIN = "regexp_replace(regexp_replace(replace(regexp_replace(html, '<!--.*?-->', '', 'g'), 'var t=\"</p>\"', 'var t=\"' || chr(1) || '\"'), '<[^<>]*>?', '', 'g'), chr(1), '</p>')"


@query()
def page_text(spark: SparkSession, d: str) -> DataFrame:
    """SQL knows few references; tests compare with brute force."""
    p = read_pages(spark, d)
    return _with_nulls(pages.page_text(p), p, "html")


@query(f"select page_id as doc_id, {_squeeze("replace(" + PLAIN + ", '&', '+')")} as text from pages")
def page_text_plain(spark: SparkSession, d: str) -> DataFrame:
    """The text of all pages, with every ampersand made a plus sign."""
    return pages.page_text(read_pages(spark, d).withColumn("html", F.expr("replace(html, '&', '+')")))


HREFS = f"select doc_id, {_unescape('href')} as href from ({LINKS})"


@query(f"select 'prefix' as op, count(*) as n from ({HREFS}) where starts_with(href, '/th') union all select 'suffix', count(*) from ({HREFS}) where ends_with(href, '.') union all select 'contains', count(*) from ({HREFS}) where contains(href, 'on') union all select 'fold', count(*) from ({HREFS}) where lower(href) = '/the' union all select 'not', count(*) from ({HREFS}) where not starts_with(href, '/t')")
def attribute_operators(spark: SparkSession, d: str) -> DataFrame:
    """Five selectors as conditions in one aggregate over the nodes relation."""
    tests = {"prefix": "a[href^='/th']", "suffix": "a[href$='.']", "contains": "a[href*='on']", "fold": "a[href='/THE' i]", "not": "a:not([href^='/t'])"}
    counts = _nodes(spark, d, "kind", "name", "attrs", where="a").agg(*[F.sum(selector_condition(s).cast("long")).alias(k) for k, s in tests.items()])
    return counts.unpivot([], list(tests), "op", "n")


@query(f"select doc_id, sum(case when len(li) > 1 then len(li) - 1 else 0 end)::bigint as later, sum(case when len(li) > 1 then 1 else 0 end)::bigint as second from ({LI}) where len(li) > 1 group by doc_id")
def sibling_items(spark: SparkSession, d: str) -> DataFrame:
    return pages.match_counts(read_pages(spark, d), {"later": "li ~ li", "second": "li:first-child + li"}).filter("later > 0")


@query(f"select doc_id, sum(case when len(li) > 1 then len(li) - 1 else 0 end)::bigint as later, sum(case when len(li) > 1 then 1 else 0 end)::bigint as second from ({LI}) where len(li) > 1 group by doc_id")
def sibling_items_plan(spark: SparkSession, d: str) -> DataFrame:
    """The same as plans over the nodes relation."""
    nodes = _nodes(spark, d, *SELECTOR_COLUMNS, where="li")
    later = select(nodes, "li ~ li").groupBy("doc_id").agg(F.count(F.lit(1)).alias("later"))
    second = select(nodes, "li:first-child + li").groupBy("doc_id").agg(F.count(F.lit(1)).alias("second"))
    return later.join(second, "doc_id")


@query(f"select page_id as doc_id, len(regexp_extract_all(html, '<a href=')) + 1 as n from pages")
def group_and_descendant(spark: SparkSession, d: str) -> DataFrame:
    return pages.match_counts(read_pages(spark, d), {"n": "nav ul a[href], body > div.ad, head > title::first-line"})


@query(f"select page_id as doc_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) as lang, len(regexp_extract_all(html, '<a href=')) as links from pages")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    register(spark)
    read_pages(spark, d).createOrReplaceTempView("pagegrain_pages")
    return spark.sql("select doc_id, max(attrs['lang']) filter (where name = 'html') as lang, count(*) filter (where name = 'a') as links from pagegrain_pages, lateral parse_html(html) group by doc_id")


@query()
def entity_decoding(spark: SparkSession, d: str) -> DataFrame:
    register(spark)
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.expr("if(text is null, null, decode_entities(coalesce(text, '')))").alias("text"))


#: References by number and by name around each text, whose own ampersands are escaped first.
@query("select doc_id, '<' || chr(233) || 'A' || text || chr(169) || '>' as text from documents")
def entity_round_trip(spark: SparkSession, d: str) -> DataFrame:
    register(spark)
    escaped = F.concat(F.lit("&lt;&eacute;&#x41;"), F.expr("replace(text, '&', '&amp;')"), F.lit("&copy;&#62;"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", escaped.alias("t")).select("doc_id", F.expr("if(t is null, null, decode_entities(coalesce(t, '')))").alias("text"))


@query("select page_id as doc_id, html as text, 'utf-8' as encoding, false as failed from pages")
def decode_html(spark: SparkSession, d: str) -> DataFrame:
    return pages.decoded(read_pages(spark, d).select("doc_id", F.encode("html", "UTF-8").alias("content")))


#: Labels of the closed list, each family once, and some that it lacks.
LABELS = {"latin1": "windows-1252", "utf-7": "windows-1252", "UTF8": "utf-8", "ISO-8859-1": "windows-1252", "cp1252": "windows-1252", " utf-8 ": "utf-8", "l1": "windows-1252", "ibm819": "windows-1252", "latin2": "iso-8859-2", "utf-16be": "utf-16be", "ascii": "utf-8", "nonsense": "utf-8"}


@query(f"select page_id as doc_id, label, encoding, encoding <> 'utf-8' or text = html as same from (select page_id, html, html as text, label, encoding from pages, (values {', '.join(f"('{k}', '{v}')" for k, v in LABELS.items())}) as v(label, encoding))")
def transport_labels(spark: SparkSession, d: str) -> DataFrame:
    """Each page's own bytes under labels of the transport; the page's meta element decides where a label is unknown."""
    rows = read_pages(spark, d).select("doc_id", "html", F.explode(F.array(*map(F.lit, LABELS))).alias("label"), F.encode("html", "UTF-8").alias("content"))
    found = pages.decoded(rows, transport="label", keep=("html", "label"))
    return found.select("doc_id", "label", "encoding", ((F.col("encoding") != "utf-8") | (F.col("text") == F.col("html"))).alias("same"))


@query("select page_id as doc_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) as lang, len(regexp_extract_all(html, '<li>')) as items, 0::bigint as ads from pages")
def edited_pages(spark: SparkSession, d: str) -> DataFrame:
    edits = [edit.Edit("remove", "div.ad"), edit.Edit("insert_before", "li:first-child", "<li class=new>n"), edit.Edit("clone", "li.new"), edit.Edit("replace", "li.new", "<i>x</i>"), edit.Edit("append", "footer", "<u>end</u>")]
    changed = edit.edit_pages(read_pages(spark, d), edits)
    nodes = pages.nodes(changed, columns=("name", "attrs"))
    return nodes.groupBy("doc_id").agg(F.max(F.when(F.col("name") == "html", F.col("attrs")["lang"])).alias("lang"), F.sum((F.col("name") == "li").cast("long")).alias("items"), F.sum((F.coalesce(F.col("attrs")["class"], F.lit("")) == "ad").cast("long")).alias("ads"))


@query("select page_id as doc_id, case when len(regexp_extract_all(html, '<p>')) > 0 then 'ok' end as windows from pages")
def position_windows(spark: SparkSession, d: str) -> DataFrame:
    """Positions that the walk gives equal those that window functions derive."""
    from pyspark.sql.window import Window

    n = _nodes(spark, d, "node_id", "parent_id", "kind", "name", "sib_idx", "elem_idx", "elem_cnt", "type_idx", "type_cnt").filter("kind = 'element' and parent_id is not null")
    w, t = Window.partitionBy("doc_id", "parent_id"), Window.partitionBy("doc_id", "parent_id", "name")
    same = (F.row_number().over(w.orderBy("sib_idx")) == F.col("elem_idx")) & (F.count(F.lit(1)).over(w) == F.col("elem_cnt")) & (F.row_number().over(t.orderBy("sib_idx")) == F.col("type_idx")) & (F.count(F.lit(1)).over(t) == F.col("type_cnt"))
    return n.select("doc_id", same.alias("same")).groupBy("doc_id").agg(F.when(F.min("same"), F.lit("ok")).alias("windows"))


@query(f"select doc_id, regexp_extract(url, '^[a-z]+://[^/]*', 0) || href as link from (select page_id as doc_id, url, {_unescape("unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))")} as href from pages)")
def resolved_links(spark: SparkSession, d: str) -> DataFrame:
    found = _nodes(spark, d, "attrs", where="[href], [src], [action]", keep=("url",))
    link = F.coalesce(F.col("attrs")["href"], F.col("attrs")["src"], F.col("attrs")["action"])
    return found.select("doc_id", resolve_url(F.col("url"), link).alias("link"))


@query(f"select page_id as doc_id, coalesce(nullif({_squeeze(_unescape("x[2]"))}, ''), {_unescape('x[1]')}) as label from (select page_id, unnest(list_zip(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1), regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2))) as x from pages)")
def link_labels(spark: SparkSession, d: str) -> DataFrame:
    """The text of a link; of one without text its target or title."""
    found = pages.matches(read_pages(spark, d), "li a", strip=True)
    return found.select("doc_id", F.coalesce(F.nullif("text", F.lit("")), F.col("attrs")["href"], F.col("attrs")["title"], F.lit("")).alias("label"))


@query()
def fragment_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts as the contents of a textarea: no tag is one there."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return _with_nulls(pages.page_text(docs, column="text", collapse=False, context=("textarea", None)), docs, "text")


@query("select doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as text from documents where text is not null")
def fragment_text_plain(spark: SparkSession, d: str) -> DataFrame:
    """The same of all texts, with their ampersands escaped first."""
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("text", F.expr("replace(text, '&', '&amp;')"))
    return pages.page_text(docs, column="text", collapse=False, context=("textarea", None))


@query(f"select page_id as doc_id, 'html' as root, len(regexp_extract_all(html, '<li>'))::bigint as parts, len(regexp_extract_all(html, '<li>'))::bigint as texts from pages")
def fragment_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The items of each page's menu as cells, parsed as the fragment of a row; the wrapper stays in the relation."""
    cells = F.expr("array_join(transform(regexp_extract_all(coalesce(html, ''), '<li>(<a href=)', 1), (x, i) -> concat('<td>', i)), '')")
    n = pages.nodes(read_pages(spark, d).select("doc_id", cells.alias("html")), columns=("kind", "name", "depth"), context=("tr", None))
    element = F.col("kind") == "element"
    return n.groupBy("doc_id").agg(F.max(F.when(element & (F.col("depth") == 1), F.col("name"))).alias("root"), F.count(F.when(element & (F.col("depth") == 2), 1)).alias("parts"), F.count(F.when((F.col("kind") == "text") & (F.col("depth") == 3), 1)).alias("texts"))


#: The pages end in the middle of an element where they were cut, which is no error of their own; each opens b once.
@query("select page_id as doc_id, sum(case when html ilike '<!doctype html>%' then 0 else 1 end)::bigint as doctype, sum(len(regexp_extract_all(html, '(?i)<!doctype')) - case when html ilike '<!doctype html>%' then 1 else 0 end)::bigint as again from pages group by page_id")
def doctype_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors of each page about its doctype."""
    found = pages.documents(read_pages(spark, d))
    count = lambda p: F.size(F.filter("errors", lambda e: e["code"].startswith(p))).cast("long")
    return found.select("doc_id", count("expected-doctype").alias("doctype"), count("unexpected-doctype").alias("again"))


@query("select page_id as doc_id, 'expected-doctype-but-got-chars' as first from pages")
def error_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """The first error of the builder where text stands before each page."""
    moved = read_pages(spark, d).select("doc_id", F.concat(F.lit("x"), "html").alias("html"))
    found = pages.describe_errors(pages.parse_errors(moved)).filter("source = 'tree'")
    return found.groupBy("doc_id").agg(F.min_by("description", "seq").alias("first"))


@query()
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_markdown(read_pages(spark, d))


@query()
def page_html(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_html(read_pages(spark, d))


@query()
def test_format(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_test_format(read_pages(spark, d))


@query()
def page_parse_errors(spark: SparkSession, d: str) -> DataFrame:
    return pages.parse_errors(read_pages(spark, d))


QUERIES |= cases.QUERIES
ORACLE_SQL |= cases.ORACLE_SQL
