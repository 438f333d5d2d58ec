"""Queries that take every page through the rarer branches of the engine: each page's own word (the letters that its title
begins with, then its number) stands in small documents, and SQL says what must come out.

A case is (name, document, result); ``@`` stands for the word in both. Dumps are written as indented lines without their prefix.
"""

from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.functions.register import register
from pagegrain.operators import edit, pages
from pagegrain.plans.selectors import SELECTOR_COLUMNS, select, selector_condition
from pagegrain.sources import read_pages

Case = tuple[str, str, str]
#: The word of a page, in SQL; the same expression is right in Spark.
WORD = "concat(regexp_extract(coalesce(html, ''), '<title>([A-Za-z]*)', 1), {})"


def quoted(s: str) -> str:
    """A string literal of SQL; marks that a literal can't hold plainly are put in by number."""
    out = "'" + s.replace("'", "''") + "'"
    for code in (0, 9, 10, 12, 13):
        out = out.replace(chr(code), f"' || chr({code}) || '")
    return out


def expected(cases: list[Case]) -> str:
    values = ", ".join(f"({quoted(n)}, {quoted(r)})" for n, _, r in cases)
    return f"select page_id as doc_id, name, replace(result, '@', {WORD.format('page_id')}) as result from pages, (values {values}) as v(name, result)"


def documents(spark: SparkSession, d: str, cases: list[Case]) -> DataFrame:
    """doc_id, name, html: each case with the word of each page."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(h).alias("html")) for n, h, _ in cases])).alias("c")
    rows = read_pages(spark, d).select("doc_id", F.expr(WORD.format("doc_id")).alias("word"), each)
    return rows.select("doc_id", "c.name", F.expr("replace(c.html, '@', word)").alias("html"))


def lines(text: str) -> str:
    """A dump from its indented lines."""
    return "\n".join("| " + x for x in dedent(text).strip("\n").split("\n"))


def in_body(name: str, html: str, body: str) -> Case:
    """A document with a doctype, and what its body holds."""
    inner = "\n".join("    " + x for x in dedent(body).strip("\n").split("\n"))
    return name, "<!DOCTYPE html>" + html, lines("<!DOCTYPE html>\n<html>\n  <head>\n  <body>\n" + inner)


def in_fragment(name: str, html: str, nodes: str) -> Case:
    return name, html, lines(nodes)


def whole(name: str, html: str, nodes: str) -> Case:
    return name, html, lines(nodes)


FORMATTING = [
    in_body("adoption of text", "<p>@<b>2<i>3</b>4</i>5</p>", """
        <p>
          "@"
          <b>
            "2"
            <i>
              "3"
          <i>
            "4"
          "5"
        """),
    in_body("adoption over a block", "<b>1<p>2</b>@</p>", """
        <b>
          "1"
        <p>
          <b>
            "2"
          "@"
        """),
    in_body("adoption over nested blocks", "<a>1<div>2<div>3</a>@</div>5</div>", """
        <a>
          "1"
        <div>
          <a>
            "2"
          <div>
            <a>
              "3"
            "@"
          "5"
        """),
    in_body("three equal elements at most", "<p><b><b><b><b><p>@", """
        <p>
          <b>
            <b>
              <b>
                <b>
        <p>
          <b>
            <b>
              <b>
                "@"
        """),
    in_body("a marker stops the search", "<b><object></b>@</object>2", """
        <b>
          <object>
            "@"
          "2"
        """),
    in_body("a link ends the one before", "<a href=1>x<a href=2>@</a>y", """
        <a>
          href="1"
          "x"
        <a>
          href="2"
          "@"
        "y"
        """),
    in_body("reconstruction in a new paragraph", "<p><i>1<p>@</i>2", """
        <p>
          <i>
            "1"
        <p>
          <i>
            "@"
          "2"
        """),
    in_body("nobr in nobr", "<nobr>1<nobr>@", """
        <nobr>
          "1"
        <nobr>
          "@"
        """),
]

TABLES = [
    in_body("text before cells moves out", "<table>@<tr><td>x</table>", """
        "@"
        <table>
          <tbody>
            <tr>
              <td>
                "x"
        """),
    in_body("elements before cells move out", "<table><tr><div>@</div><td>x</table>", """
        <div>
          "@"
        <table>
          <tbody>
            <tr>
              <td>
                "x"
        """),
    in_body("white space stays", "<table> <tr> <td>@</td> </tr> </table>", """
        <table>
          " "
          <tbody>
            <tr>
              " "
              <td>
                "@"
              " "
            " "
        """),
    in_body("formatting that moved out goes on", "<table><b>@<tr><td>y</table>z", """
        <b>
          "@"
        <table>
          <tbody>
            <tr>
              <td>
                "y"
        <b>
          "z"
        """),
    in_body("caption, columns, parts", "<table><caption>@<col><thead><tr><th>h<tfoot><tr><td>f", """
        <table>
          <caption>
            "@"
          <colgroup>
            <col>
          <thead>
            <tr>
              <th>
                "h"
          <tfoot>
            <tr>
              <td>
                "f"
        """),
    in_body("hidden inputs stay, others move out", "<table><input type=hidden><input value=@></table>", """
        <input>
          value="@"
        <table>
          <input>
            type="hidden"
        """),
    whole("quirks keep a table in its paragraph", "<p>1<table><tr><td>@", """
        <html>
          <head>
          <body>
            <p>
              "1"
              <table>
                <tbody>
                  <tr>
                    <td>
                      "@"
        """),
    in_body("otherwise a table ends it", "<p>1<table><tr><td>@", """
        <p>
          "1"
        <table>
          <tbody>
            <tr>
              <td>
                "@"
        """),
    in_body("select in a table cell", "<table><tr><td><select><option>@<tr><td>x", """
        <table>
          <tbody>
            <tr>
              <td>
                <select>
                  <option>
                    "@"
            <tr>
              <td>
                "x"
        """),
]

FOREIGN = [
    in_body("svg names and CDATA", '<svg viewbox="0 0 1 1" xlink:href="@"><foreignobject><p>x</p></foreignobject><![CDATA[a<b]]></svg>', """
        <svg svg>
          viewBox="0 0 1 1"
          xlink href="@"
          <svg foreignObject>
            <p>
              "x"
          "a<b"
        """),
    in_body("math text points", '<math definitionurl="@"><mi>x<b>y</b></mi></math>', """
        <math math>
          definitionURL="@"
          <math mi>
            "x"
            <b>
              "y"
        """),
    in_body("html breaks out", "<svg><g>@<p>x</svg>", """
        <svg svg>
          <svg g>
            "@"
        <p>
          "x"
        """),
    in_body("annotations hold html", '<math><annotation-xml encoding="text/html"><div>@</div></annotation-xml></math>', """
        <math math>
          <math annotation-xml>
            encoding="text/html"
            <div>
              "@"
        """),
    in_body("only a font with a colour breaks out", "<svg><font>@</font><font color=red>x</svg>", """
        <svg svg>
          <svg font>
            "@"
        <font>
          color="red"
          "x"
        """),
    in_body("self-closing tags close", "<svg><path/><circle r=1 />@</svg>x", """
        <svg svg>
          <svg path>
          <svg circle>
            r="1"
          "@"
        "x"
        """),
    in_body("CDATA outside is a comment", "<p><![CDATA[@]]>x", """
        <p>
          <!-- [CDATA[@]] -->
          "x"
        """),
]

RAW = [
    whole("a script in a comment in a script", "<!DOCTYPE html><script><!--<script>@</script>--></script>x", """
        <!DOCTYPE html>
        <html>
          <head>
            <script>
              "<!--<script>@</script>-->"
          <body>
            "x"
        """),
    whole("an escaped script ends", "<!DOCTYPE html><script><!--@</script>x", """
        <!DOCTYPE html>
        <html>
          <head>
            <script>
              "<!--@"
          <body>
            "x"
        """),
    whole("a longer name doesn't end a script", "<!DOCTYPE html><script>@</scriptx></SCRIPT >x", """
        <!DOCTYPE html>
        <html>
          <head>
            <script>
              "@</scriptx>"
          <body>
            "x"
        """),
    in_body("plaintext never ends", "<p>1<plaintext>@</p></plaintext>", """
        <p>
          "1"
        <plaintext>
          "@</p></plaintext>"
        """),
    in_body("textarea decodes, drops its first newline", "<textarea>\n&amp;@<b></textarea>", """
        <textarea>
          "&@<b>"
        """),
    in_body("xmp doesn't decode", "<xmp>&amp;@<b></xmp>", """
        <xmp>
          "&amp;@<b>"
        """),
    in_body("the first attribute wins", "<p id=1 ID=2 id=\"@\" class='a' =b>x", """
        <p>
          =b=""
          class="a"
          id="1"
          "x"
        """),
    in_body("numbers", "<p>&#65;&#x42;&#128;&#0;&#xD800;&#x110000;&#x;@", """
        <p>
          "AB€���&#x;@"
        """),
    in_body("names", "<p>&notit;&notin;&amp@&nope;&Aacute", """
        <p>
          "¬it;∉&@&nope;Á"
        """),
    in_body("names in attributes", '<p title="&copy=1&copy;&copyx&amp;@">x', """
        <p>
          title="&copy=1©&copyx&@"
          "x"
        """),
    in_body("ASCII letters alone are lowered", "<DIV Data-É=\"@\">É", """
        <div>
          data-É="@"
          "É"
        """),
    whole("comments everywhere", "<!--1--><!DOCTYPE html><!--2--><html><!--3--><head></head><!--4--><body>@</body><!--5--></html><!--6-->", """
        <!-- 1 -->
        <!DOCTYPE html>
        <!-- 2 -->
        <html>
          <!-- 3 -->
          <head>
          <!-- 4 -->
          <body>
            "@"
          <!-- 5 -->
        <!-- 6 -->
        """),
    whole("odd comments", "<!DOCTYPE html><!--><!---><!-- @ --!><?pi></ x><!x>", """
        <!DOCTYPE html>
        <!--  -->
        <!--  -->
        <!--  @  -->
        <!-- ?pi -->
        <!--  x -->
        <!-- x -->
        <html>
          <head>
          <body>
        """),
    whole("doctype identifiers", '<!DOCTYPE HTML PUBLIC "-//W3C//DTD HTML 4.01//EN" "http://www.w3.org/TR/html4/strict.dtd"><p>@', """
        <!DOCTYPE html "-//W3C//DTD HTML 4.01//EN" "http://www.w3.org/TR/html4/strict.dtd">
        <html>
          <head>
          <body>
            <p>
              "@"
        """),
    whole("a doctype without a name", "<!DOCTYPE><p>@", """
        <!DOCTYPE >
        <html>
          <head>
          <body>
            <p>
              "@"
        """),
]

BODY = [
    in_body("headings end headings", "<h1>@<h2>x</h3>y", """
        <h1>
          "@"
        <h2>
          "x"
        "y"
        """),
    in_body("list items end list items", "<ul><li>@<li>b<ul><li>c</ul><li>d</ul>", """
        <ul>
          <li>
            "@"
          <li>
            "b"
            <ul>
              <li>
                "c"
          <li>
            "d"
        """),
    in_body("terms and details", "<dl><dt>@<dd>b<dt>c</dl>", """
        <dl>
          <dt>
            "@"
          <dd>
            "b"
          <dt>
            "c"
        """),
    in_body("end tags that make elements", "<body></p>@</br>x", """
        <p>
        "@"
        <br>
        "x"
        """),
    in_body("any other end tag", "<span><em>@</span>x</em>y", """
        <span>
          <em>
            "@"
        <em>
          "x"
        "y"
        """),
    in_body("a form in a form", "<form id=1><form id=2>@</form>x", """
        <form>
          id="1"
          "@"
        "x"
        """),
    in_body("a button in a button", "<button>1<button>@", """
        <button>
          "1"
        <button>
          "@"
        """),
    in_body("void elements, image", "<br>@<image src=x><hr>y<wbr>", """
        <br>
        "@"
        <img>
          src="x"
        <hr>
        "y"
        <wbr>
        """),
    in_body("ruby", "<ruby>@<rt>a<rp>b<rtc>c</ruby>", """
        <ruby>
          "@"
          <rt>
            "a"
          <rp>
            "b"
          <rtc>
            "c"
        """),
    in_body("template contents", "<div><template><tr><td>@</template>x", """
        <div>
          <template>
            content
              <tr>
                <td>
                  "@"
          "x"
        """),
    in_body("the selected option shows", "<select><button><selectedcontent></selectedcontent></button><option>1<option selected>@</select>", """
        <select>
          <button>
            <selectedcontent>
              "@"
          <option>
            "1"
          <option>
            selected=""
            "@"
        """),
    whole("a frameset", "<!DOCTYPE html><frameset cols=@><frame src=a></frameset><noframes>x", """
        <!DOCTYPE html>
        <html>
          <head>
          <frameset>
            cols="@"
            <frame>
              src="a"
          <noframes>
            "x"
        """),
    whole("attributes of a second html and body", "<!DOCTYPE html><html a=1><body b=1><html a=2 c=@><body b=2 d=@>x", """
        <!DOCTYPE html>
        <html>
          a="1"
          c="@"
          <head>
          <body>
            b="1"
            d="@"
            "x"
        """),
    whole("head content after the head", "<!DOCTYPE html><head></head><title>@</title><p>x", """
        <!DOCTYPE html>
        <html>
          <head>
            <title>
              "@"
          <body>
            <p>
              "x"
        """),
    whole("an empty document", "", """
        <html>
          <head>
          <body>
        """),
]

#: Fragments by the element that they are parsed in.
FRAGMENTS: dict[tuple[str, str | None], list[Case]] = {
    ("tr", None): [in_fragment("cells", "<td>@</td><th>b", """
        <td>
          "@"
        <th>
          "b"
        """)],
    ("table", None): [in_fragment("rows", "<tr><td>@", """
        <tbody>
          <tr>
            <td>
              "@"
        """)],
    ("textarea", None): [in_fragment("textarea", "<b>&lt;@</b>", """
        "<b><@</b>"
        """)],
    ("script", None): [in_fragment("script", "<b>&lt;@", """
        "<b>&lt;@"
        """)],
    ("style", None): [in_fragment("style", "<!--@&amp;", """
        "<!--@&amp;"
        """)],
    ("div", None): [in_fragment("div", "<td>@</td><p>x", """
        "@"
        <p>
          "x"
        """)],
    ("template", None): [in_fragment("template", "<tr><td>@", """
        <tr>
          <td>
            "@"
        """)],
    ("svg", "svg"): [in_fragment("svg", "<lineargradient id=@ /><p>x", """
        <svg linearGradient>
          id="@"
        <p>
          "x"
        """)],
}

HTML = [
    ("text and attributes are escaped", "<!DOCTYPE html><p title='a&quot;b' lang=en id='' data-x='1 2'>@ &amp; &lt;i&gt;", "<!DOCTYPE html><html><head></head><body><p data-x=\"1 2\" id lang=en title='a\"b'>@ &amp; &lt;i&gt;</p></body></html>"),
    ("both quotes", "<!DOCTYPE html><p title=\"'&quot;&amp;@\">x", "<!DOCTYPE html><html><head></head><body><p title=\"'&quot;&amp;@\">x</p></body></html>"),
    ("void elements and comments", "<!DOCTYPE html><p>@<br><img src=a><!--c--></p>", "<!DOCTYPE html><html><head></head><body><p>@<br><img src=a><!--c--></p></body></html>"),
    ("script text is escaped", "<!DOCTYPE html><script>a<b&&@</script>", "<!DOCTYPE html><html><head><script>a&lt;b&amp;&amp;@</script></head><body></body></html>"),
    ("template contents", "<!DOCTYPE html><template><b>@</b></template>", "<!DOCTYPE html><html><head><template><b>@</b></template></head><body></body></html>"),
    ("foreign elements", "<!DOCTYPE html><svg viewbox=1><a id=@ /></svg>", "<!DOCTYPE html><html><head></head><body><svg viewBox=1><a id=@></a></svg></body></html>"),
]

PRETTY = [
    ("nested blocks are indented", "<!DOCTYPE html><ul><li>@<li><b>x</b></ul>", "<!DOCTYPE html>\n<html>\n  <head></head>\n  <body>\n    <ul>\n      <li>@</li>\n      <li>\n        <b>x</b>\n      </li>\n    </ul>\n  </body>\n</html>"),
    ("white space of text collapses", "<!DOCTYPE html><p>  a \n @  ", "<!DOCTYPE html>\n<html>\n  <head></head>\n  <body>\n    <p>a @</p>\n  </body>\n</html>"),
]

MARKDOWN = [
    ("headings", "<h1>@</h1><h3>b</h3>", "# @\n\n### b"),
    ("paragraphs", "<p>@</p><p>b\n  c</p>", "@\n\nb c"),
    ("emphasis", "<p><strong>@</strong> <em>b</em> <b>c</b> <i>d</i> <del>e</del>", "**@** *b* **c** *d* ~~e~~"),
    ("links and images", '<p><a href="/@">x</a> <img src=i.png alt=@>', "[x](/@) ![@](i.png)"),
    ("code", "<p><code>@</code></p><pre>a\n  b</pre>", "`@`\n\n```\na\n  b\n```"),
    ("bullets", "<ul><li>@<li>b</ul>", "- @\n- b"),
    ("numbers", "<ol><li>@<li>b</ol>", "1. @\n2. b"),
    ("quotes and rules", "<blockquote>@</blockquote><hr>", "> @\n\n---"),
    ("tables", "<p>@</p><table><tr><th>a<th>long<tr><td>1<td>2<td>3</table>", "@\n\n| a   | long |     |\n| --- | ---- | --- |\n| 1   | 2    | 3   |"),
    ("nested lists", "<ul><li>@<ul><li>b</ul></ul>", "- @\n\n\n  - b"),
    ("what is left out", "<title>t</title><style>s</style><script>j</script><p>@<!--c--></p><template>x</template>", "@"),
    ("breaks", "<p>@<br>b", "@  \nb"),
]

#: Documents and the descriptions of their errors, in order.
ERRORS = [
    ("no doctype before text", "@", "expected-doctype-but-got-chars"),
    ("no doctype before a tag", "<p>@", "expected-doctype-but-got-start-tag"),
    ("a null", "<!DOCTYPE html><p>\0@", "(1,19): unexpected-null-character unexpected-null-character"),
    ("an end tag without its start", "<!DOCTYPE html><p>@</b>", "unexpected-end-tag"),
    ("text in a table", "<!DOCTYPE html><table>@</table>", "unexpected-char-in-table"),
    ("attributes without space between", '<!DOCTYPE html>\n<p a=1 b="x"c>@', "(2,13): missing-whitespace-between-attributes"),
    ("references", "<!DOCTYPE html><p>&nope;&#0;&amp @", "(1,24): unknown-named-character-reference (1,29): null-character-reference (1,33): missing-semicolon-after-character-reference"),
    ("a wrong end of a comment", "<!DOCTYPE html><!--a--!>@", "(1,21): incorrectly-closed-comment"),
    ("html in svg", "<!DOCTYPE html><svg><p>@", "unexpected-start-tag"),
    ("formatting over a block", "<!DOCTYPE html><b><p>@</b>x", "adoption-agency-1.3"),
    ("a second doctype", "<!DOCTYPE html><!DOCTYPE html>@", "unexpected-doctype"),
    ("a question mark", "<!DOCTYPE html><?x>@", "(1,17): unexpected-question-mark-instead-of-tag-name"),
    ("an empty end tag", "<!DOCTYPE html></>@", "(1,18): missing-end-tag-name"),
    ("an attribute without its value", "<!DOCTYPE html><p x=>@", "(1,21): missing-attribute-value"),
    ("CDATA in html", "<!DOCTYPE html><![CDATA[@]]>", "(1,18): cdata-in-html-content"),
    ("an empty doctype", "<!DOCTYPE>@", "(1,10): missing-doctype-name"),
    ("an open template", "<!DOCTYPE html><template>@", "eof-in-template"),
    ("no error", "<!DOCTYPE html><p>@", ""),
]

#: Bytes: name, label of the transport, head in hexadecimal, charset of the word behind it, encoding, whether it fails, text.
BYTES = [
    ("mark of utf-8", None, "EFBBBFC3A9", "UTF-8", "utf-8", False, "é@"),
    ("mark of utf-16le", None, "FFFEE900", "UTF-16LE", "utf-16le", False, "é@"),
    ("mark of utf-16be", None, "FEFF00E9", "UTF-16BE", "utf-16be", False, "é@"),
    ("meta charset", None, b"<meta charset=utf-8>\xc3\xa9".hex(), "UTF-8", "utf-8", False, "<meta charset=utf-8>é@"),
    ("meta content", None, b"<meta http-equiv=content-type content='text/html; charset=iso-8859-2'>\xe8".hex(), "UTF-8", "iso-8859-2", False, "<meta http-equiv=content-type content='text/html; charset=iso-8859-2'>č@"),
    ("meta of utf-16 means utf-8", None, b"<meta charset=utf-16>\xc3\xa9".hex(), "UTF-8", "utf-8", False, "<meta charset=utf-16>é@"),
    ("meta in a comment", None, b"<!--<meta charset=utf-8>-->\xe9".hex(), "UTF-8", "windows-1252", False, "<!--<meta charset=utf-8>-->é@"),
    ("nothing known", None, "80", "UTF-8", "windows-1252", False, "€@"),
    ("an unknown label", "klingon", "80", "UTF-8", "windows-1252", False, "€@"),
    ("the label wins", " Latin1 ", "E9", "UTF-8", "windows-1252", False, "é@"),
    ("the label wins over meta", "utf-8", b"<meta charset=windows-1252>\xc3\xa9".hex(), "UTF-8", "utf-8", False, "<meta charset=windows-1252>é@"),
    ("bytes that don't fit", "utf8", "FF", "UTF-8", "utf-8", True, ""),
    ("euc-jp", "euc-jp", "A4A2", "UTF-8", "euc-jp", False, "あ@"),
]

CASES: dict[str, list[Case]] = {"formatting_cases": FORMATTING, "table_cases": TABLES, "foreign_cases": FOREIGN, "token_cases": RAW, "body_cases": BODY, "fragment_cases": [(f"{c[0]}: {n}", h, r) for c, cs in FRAGMENTS.items() for n, h, r in cs], "html_cases": HTML, "pretty_cases": PRETTY, "markdown_cases": MARKDOWN, "error_cases": ERRORS}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {name: expected(cases) for name, cases in CASES.items()}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _dumped(cases: list[Case]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return pages.page_test_format(documents(spark, d, cases), keep=("name",)).withColumnRenamed("dump", "result")

    return run


for _name in ("formatting_cases", "table_cases", "foreign_cases", "token_cases", "body_cases"):
    QUERIES[_name] = _dumped(CASES[_name])


@query()
def fragment_cases(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of eight contexts, each parsed in its own."""
    parts = [pages.page_test_format(documents(spark, d, cases), keep=("name",), context=c).select("doc_id", F.concat(F.lit(f"{c[0]}: "), "name").alias("name"), F.col("dump").alias("result")) for c, cases in FRAGMENTS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query()
def html_cases(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_html(documents(spark, d, HTML), keep=("name",), pretty=False).withColumnRenamed("html", "result")


@query()
def pretty_cases(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_html(documents(spark, d, PRETTY), keep=("name",)).withColumnRenamed("html", "result")


@query()
def markdown_cases(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_markdown(documents(spark, d, MARKDOWN), keep=("name",)).withColumnRenamed("markdown", "result")


@query()
def error_cases(spark: SparkSession, d: str) -> DataFrame:
    """The descriptions of all errors of a document, with those that have none."""
    found = pages.documents(documents(spark, d, ERRORS), keep=("name",))
    each = F.transform("errors", lambda e: F.when(e["line"].isNull(), e["code"]).otherwise(F.concat(F.lit("("), e["line"], F.lit(","), e["column"], F.lit("): "), e["code"])))
    return found.select("doc_id", "name", F.array_join(each, " ").alias("result"))


def _first(descriptions: str) -> str:
    place, *more = descriptions.split(" ")
    return f"{place} {more[0]}" if place.startswith("(") else place


@query(f"select page_id as doc_id, name, replace(result, '@', {WORD.format('page_id')}) as status from pages, (values {', '.join(f'({quoted(n)}, {quoted(_first(r)) if r else "null"})' for n, _, r in ERRORS)}) as v(name, result)")
def strict_status(spark: SparkSession, d: str) -> DataFrame:
    """The error that a strict parse of a document ends with, null where it has none."""
    return pages.strict_status(documents(spark, d, ERRORS), keep=("name",)).select("doc_id", "name", "status")


@query(f"select page_id as doc_id, name, encoding, failed, replace(result, '@', {WORD.format('page_id')}) as text from pages, (values {', '.join(f'({quoted(n)}, {quoted(e)}, {str(f).lower()}, {quoted(t)})' for n, _, _, _, e, f, t in BYTES)}) as v(name, encoding, failed, result)")
def byte_cases(spark: SparkSession, d: str) -> DataFrame:
    """Byte order marks, declarations and labels of the transport, each before the page's word."""
    word = F.expr(WORD.format("doc_id"))
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(label).cast("string").alias("label"), F.concat(F.unhex(F.lit(head)), F.encode(word, charset)).alias("content")) for n, label, head, charset, *_ in BYTES])
    rows = read_pages(spark, d).select("doc_id", F.explode(each).alias("c")).select("doc_id", "c.*")
    return pages.decoded(rows, transport="label", keep=("name",)).select("doc_id", "name", "encoding", "failed", "text")


@query(f"select page_id as doc_id, 'utf-16le' as encoding, 2::bigint as starts, {WORD.format('page_id')} as text, 'p' as last_name, 3::bigint as nodes from pages")
def transported_events(spark: SparkSession, d: str) -> DataFrame:
    """Events, nodes and encoding of pages that come as bytes with a label."""
    content = F.encode(F.concat(F.lit("<p><b>"), F.expr(WORD.format("doc_id")), F.lit("</b></p>")), "UTF-16LE")
    rows = read_pages(spark, d).select("doc_id", content.alias("html"), F.lit("utf-16le").alias("label"))
    events = pages.html_events(rows, transport="label").groupBy("doc_id").agg(F.sum((F.col("kind") == "start").cast("long")).alias("starts"), F.max(F.when(F.col("kind") == "text", F.col("data"))).alias("text"), F.max_by("name", F.when(F.col("kind") == "end", F.col("seq"))).alias("last_name"))
    found = pages.documents(rows, transport="label").select("doc_id", "encoding", (F.col("n_nodes") - 4).cast("long").alias("nodes"))
    return found.join(events, "doc_id")


@query(f"select page_id as doc_id, name, {WORD.format('page_id')} || tail as data from pages, (values ('bom', ' x'), ('xml', ' x' || chr(65533)), ('xml comment', '- -y')) as v(name, tail)")
def scanner_options(spark: SparkSession, d: str) -> DataFrame:
    """Tokens with the mark at the front dropped, and with what XML can't hold replaced."""
    word = F.expr(WORD.format("doc_id"))
    p = read_pages(spark, d)
    bom = pages.tokens(p.select("doc_id", F.concat(F.lit("\ufeff"), word, F.lit(" x")).alias("html")), discard_bom=True).filter("kind = 'character'").select("doc_id", F.lit("bom").alias("name"), "data")
    xml = pages.tokens(p.select("doc_id", F.concat(word, F.lit("\fx\ufdd0<!--"), word, F.lit("--y-->")).alias("html")), xml_coercion=True).filter("kind in ('character', 'comment')")
    return bom.union(xml.select("doc_id", F.when(F.col("kind") == "comment", F.lit("xml comment")).otherwise(F.lit("xml")).alias("name"), "data"))


@query(f"select page_id as doc_id, name, replace(result, '@', {WORD.format('page_id')}) as result from pages, (values ('events', 'start p|text @|end p'), ('errors', 'expected-doctype-but-got-start-tag|unexpected-end-tag'), ('select', 'b @'), ('fragment', 'td|@')) as v(name, result)")
def table_functions(spark: SparkSession, d: str) -> DataFrame:
    """The SQL table functions: events, errors, matches, and the nodes of a fragment."""
    register(spark)
    word = WORD.format("doc_id")
    read_pages(spark, d).selectExpr("doc_id", f"{word} as w").createOrReplaceTempView("pagegrain_words")
    listed = "array_join(transform(array_sort(collect_list(struct(t.{0}, {1} as x))), s -> s.x), '|') as result from pagegrain_words, lateral {2} as t {3} group by doc_id"
    return spark.sql(
        "select doc_id, 'events' as name, " + listed.format("seq", "concat_ws(' ', t.kind, t.name, t.data)", "html_events(concat('<p>', w, '</p>'))", "")
        + " union all select doc_id, 'errors', " + listed.format("seq", "t.description", "html_errors(concat('<p>', w, '</b>'))", "")
        + " union all select doc_id, 'select', " + listed.format("match", "concat_ws(' ', t.name, t.text)", "html_select(concat('<p><b>', w, '</b><i>x'), 'p > b')", "")
        + " union all select doc_id, 'fragment', " + listed.format("node_id", "coalesce(t.data, t.name)", "parse_html(concat('<td>', w), 'tr')", "where t.depth > 1")
    )


# --- selectors --------------------------------------------------------------------------------------------------------

ITEMS = "len(regexp_extract_all(coalesce(html, ''), '<li>'))"
#: Selectors without combinators, and with them, and their matches in a document with n list items.
LOCAL = {
    "any": ("*", "13 + n"), "id": ("#top", "1"), "class": (".y", "1"), "classes": ("li.b.a", "n"), "type": ("LI", "n"), "has": ("[data-k]", "1"), "equals": ("[class='x y']", "1"),
    "word": ("[data-k~=q]", "1"), "dash": ("[lang|=en]", "1"), "prefix": ("[class^=a]", "n"), "suffix": ("[class$=b]", "n"), "within": ("[class*=' ']", "n + 1"), "folded": ("[DATA-K='P Q' i]", "1"),
    "first": ("li:first-child", "least(n, 1)"), "last": ("li:last-child", "least(n, 1)"), "only": ("b:only-child", "1"), "second": ("li:nth-child(2n)", "n // 2"), "odd": ("li:nth-child(odd)", "(n + 1) // 2"),
    "from_end": ("li:nth-last-child(3n+1)", "(n + 2) // 3"), "first_two": ("li:nth-child(-n+2)", "least(n, 2)"), "first_type": ("p:first-of-type", "1"), "last_type": ("p:last-of-type", "1"), "only_type": ("em:only-of-type", "1"),
    "nth_type": ("p:nth-of-type(2)", "1"), "nth_last_type": ("p:nth-last-of-type(even)", "2"), "empty": ("p:empty", "2"), "root": ("html:root", "1"), "not_first": ("li:not(:first-child)", "greatest(n - 1, 0)"), "pseudo": ("p::before", "0"), "group": ("em, b, #top", "3"),
}
COMBINED = {
    "child": ("div > ul > li", "n"), "descendant": ("div li", "n"), "deep": ("body div ul li.a", "n"), "next": ("li + li", "greatest(n - 1, 0)"), "later": ("li ~ li", "greatest(n - 1, 0)"), "after": ("ul + p", "1"),
    "all_after": ("ul ~ p", "4"), "mixed": ("section b, div p:nth-of-type(3) + em", "2"), "chain": ("div > ul ~ p + em ~ p", "1"),
}


def _counts_sql(selectors: dict[str, tuple[str, str]]) -> str:
    return f"select doc_id, {', '.join(f'({count})::bigint as "{name}"' for name, (_, count) in selectors.items())} from (select page_id as doc_id, {ITEMS}::bigint as n from pages)"


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """A document with as many list items as the page has."""
    items = F.expr("repeat('<li class=\"a b\">x</li>', size(regexp_extract_all(coalesce(html, ''), '(<li>)', 1)))")
    parts = "<!DOCTYPE html><html lang=en-GB><body><div id=top class='x y' data-k='p q'><ul>", "</ul><p></p><p><!--c--></p><p>t</p><em>1</em><p>u</p></div><section><b>only</b></section>"
    return read_pages(spark, d).select("doc_id", F.concat(F.lit(parts[0]), items, F.lit(parts[1])).alias("html"))


@query(_counts_sql(LOCAL | COMBINED))
def selector_counts(spark: SparkSession, d: str) -> DataFrame:
    """All selectors inside one parse of each page."""
    return pages.match_counts(_listed(spark, d), {name: s for name, (s, _) in (LOCAL | COMBINED).items()})


@query(_counts_sql(LOCAL))
def selector_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Selectors without combinators as conditions on the nodes relation: one aggregate for all."""
    n = pages.nodes(_listed(spark, d))
    return n.groupBy("doc_id").agg(*[F.sum(selector_condition(s).cast("long")).alias(name) for name, (s, _) in LOCAL.items()])


@query("select * from (" + " union all ".join(f"select page_id as doc_id, '{name}' as name, ({count})::bigint as n from (select page_id, {ITEMS} as n from pages)" for name, (_, count) in COMBINED.items()) + ") where n > 0")
def selector_plans(spark: SparkSession, d: str) -> DataFrame:
    """Selectors with combinators as plans over the nodes relation."""
    n = pages.nodes(_listed(spark, d), columns=SELECTOR_COLUMNS)
    parts = [select(n, s).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.lit(name).alias("name"), "n") for name, (s, _) in COMBINED.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


# --- nodes and edits --------------------------------------------------------------------------------------------------


@query(f"select page_id as doc_id, {WORD.format('page_id')} as own, 5::bigint as parents, 2::bigint as leaves from pages")
def node_properties(spark: SparkSession, d: str) -> DataFrame:
    """A node's own text is that of text nodes alone; nodes with something below them, and without."""
    rows = read_pages(spark, d).select("doc_id", F.concat(F.lit("<!DOCTYPE html><body><p>"), F.expr(WORD.format("doc_id"))).alias("html"))
    n = pages.nodes(rows, columns=("node_id", "last_pre", "kind", "name", "data")).filter("name <> '!doctype'")
    has_children = F.col("last_pre") > F.col("node_id")
    found = n.groupBy("doc_id").agg(F.array_join(F.collect_list(pages.own_text()), "").alias("own"), F.sum(has_children.cast("long")).alias("parents"), F.sum((~has_children).cast("long")).alias("leaves"))
    return found.withColumn("parents", F.col("parents") + 1)


EDITS = [
    ("append", "<p>@</p>", edit.Edit("append", "p", "<b>x</b>"), "<p>@<b>x</b></p>"),
    ("remove", "<p>@<b>x</b></p>", edit.Edit("remove", "b"), "<p>@</p>"),
    ("insert_before", "<p>@<b>x</b></p>", edit.Edit("insert_before", "b", "<i>y</i>"), "<p>@<i>y</i><b>x</b></p>"),
    ("replace", "<p>@<b>x</b>z</p>", edit.Edit("replace", "b", "<i>y</i>w"), "<p>@<i>y</i>wz</p>"),
    ("clone", "<ul><li>@</ul>", edit.Edit("clone", "li"), "<ul><li>@</li><li>@</li></ul>"),
]


@query(f"select page_id as doc_id, name, replace(result, '@', {WORD.format('page_id')}) as html from pages, (values {', '.join(f'({quoted(n)}, {quoted("<html><head></head><body>" + r + "</body></html>")})' for n, _, _, r in EDITS)}) as v(name, result)")
def edit_cases(spark: SparkSession, d: str) -> DataFrame:
    parts = [edit.edit_pages(documents(spark, d, [(n, h, "")]), [e]).select("doc_id", F.lit(n).alias("name"), "html") for n, h, e, _ in EDITS]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
