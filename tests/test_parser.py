"""Trees of the parser, by the canonical dump."""

import random

import pytest

from pagegrain.functions.nodeset import number
from pagegrain.functions.output import to_test_format, to_text
from pagegrain.functions.tokenizer import tokenize
from pagegrain.functions.tree import parse, walk


def tree(html, context=None, **options):
    return to_test_format(parse(html, context, **options)[0])


def body(html, **options):
    """The dump of what a page's body holds, with one space of indent left out for each level above."""
    lines = tree(html, **options).split("\n")
    at = lines.index("|   <body>")
    return "\n".join("| " + line[6:] if line.startswith("|     ") else line for line in lines[at + 1 :])


CASES = {
    "formatting is split over a closed block": ("<p>1<b>2<i>3</b>4</i>5</p>", '| <p>\n|   "1"\n|   <b>\n|     "2"\n|     <i>\n|       "3"\n|   <i>\n|     "4"\n|   "5"'),
    "adoption with a furthest block": ("<a>1<p>2</a>3</p>", '| <a>\n|   "1"\n| <p>\n|   <a>\n|     "2"\n|   "3"'),
    "implied table parts": ("<table><td>x", '| <table>\n|   <tbody>\n|     <tr>\n|       <td>\n|         "x"'),
    "text before a table": ("<table>a<tr><td>b", '| "a"\n| <table>\n|   <tbody>\n|     <tr>\n|       <td>\n|         "b"'),
    "list items close each other": ("<ul><li>a<li>b", '| <ul>\n|   <li>\n|     "a"\n|   <li>\n|     "b"'),
    "three equal formatting elements": ("<b><b><b><b>x</p>y", '| <b>\n|   <b>\n|     <b>\n|       <b>\n|         "x"\n|         <p>\n|         "y"'),
    "end of p without p": ("<body></p>", "| <p>"),
    "end of br": ("</br>", "| <br>"),
    "heading in heading": ("<h1>a<h2>b", '| <h1>\n|   "a"\n| <h2>\n|   "b"'),
    "button in button": ("<button>a<button>b", '| <button>\n|   "a"\n| <button>\n|   "b"'),
    "foreign names and integration": ("<svg viewbox=1><FOREIGNOBJECT><p>x</svg>", '| <svg svg>\n|   viewBox="1"\n|   <svg foreignObject>\n|     <p>\n|       "x"'),
    "breakout of foreign content": ("<svg><p>x", '| <svg svg>\n| <p>\n|   "x"'),
    "cdata in foreign content": ("<svg><![CDATA[a<b]]></svg>", '| <svg svg>\n|   "a<b"'),
    "cdata elsewhere": ("<![CDATA[a]]>b", '| "b"'),
    "image is img": ("<image src=x>", '| <img>\n|   src="x"'),
    "select drops unknown elements": ("<select><option>a<div>b</div><foo>c</select>", '| <select>\n|   <option>\n|     "a"\n|     <div>\n|       "b"\n|     "c"'),
    "plaintext takes all": ("<plaintext></plaintext>x", '| <plaintext>\n|   "</plaintext>x"'),
    "first attribute wins": ("<p ID=a id=b>", '| <p>\n|   id="a"'),
    "a newline after pre": ("<pre>\n\nx</pre>", '| <pre>\n|   "\nx"'),
    "null in text and in a name": ("<p\0>a\0b", '| <p�>\n|   "ab"'),
    "ruby": ("<ruby>a<rt>b<rp>c", '| <ruby>\n|   "a"\n|   <rt>\n|     "b"\n|   <rp>\n|     "c"'),
    "named references": ("&amp;&ampx&notin;&notit;&fjlig;&nosuch;", '| "&&x∉¬it;fj&nosuch;"'),
    "numeric references": ("&#65;&#x41;&#128;&#0;&#xD800;&#x110000;&#1", '| "AA€���\x01"'),
}


@pytest.mark.parametrize("name", CASES)
def test_body(name):
    html, expected = CASES[name]
    assert body("<!DOCTYPE html>" + html) == expected


def test_select_fragments():
    assert tree("<table></table><li><table></table>", ("select", None)) == "| <table>\n| <li>\n|   <table>"
    expected = '| <table>\n|   <tbody>\n|     <tr>\n|       <td>\n|         "cell"\n| <li>\n|   <table>\n|     <tbody>\n|       <tr>\n|         <td>\n|           "x"'
    assert tree("<table><tr><td>cell</td></tr></table><li><table><tr><td>x</td></tr></table>", ("select", None)) == expected


def test_fragment_contexts():
    assert tree("Hello <b>World</b>", ("textarea", None)) == '| "Hello <b>World</b>"'
    assert tree("<td>x", ("tr", None)) == '| <td>\n|   "x"'
    assert tree("<tr><td>x", ("tbody", None)) == '| <tr>\n|   <td>\n|     "x"'
    assert tree("<circle/>a", ("svg", "svg")) == '| <svg circle>\n| "a"'
    assert tree("x<p>y", ("div", None)) == '| "x"\n| <p>\n|   "y"'


def test_head_and_frames():
    assert tree("<title>a</title><body>b") == '| <html>\n|   <head>\n|     <title>\n|       "a"\n|   <body>\n|     "b"'
    assert tree("<frameset><frame></frameset><noframes>x") == '| <html>\n|   <head>\n|   <frameset>\n|     <frame>\n|   <noframes>\n|     "x"'
    assert tree("<!--a--><!DOCTYPE html PUBLIC 'p' 's'><!--b-->").split("\n")[:3] == ["| <!-- a -->", '| <!DOCTYPE html "p" "s">', "| <!-- b -->"]
    assert tree("") == "| <html>\n|   <head>\n|   <body>"


def test_noscript_follows_scripting():
    assert '"<p>x"' in tree("<noscript><p>x</noscript>", scripting=True)
    assert "<p>" in tree("<body><noscript><p>x</noscript>")


def test_template_contents():
    assert tree("<template><tr><td>x</template>").split("\n")[3:] == ["|       content", "|         <tr>", "|           <td>", '|             "x"', "|   <body>"]
    root = parse("<div><template><p>in</p></template>out</div>")[0]
    assert to_text(root) == "out"
    rows = number(root)[1]
    inner = next(r for r in rows if r["name"] == "p")
    host = next(r for r in rows if r["name"] == "template")
    assert host["node_id"] < inner["node_id"] <= host["last_pre"] and inner["tree_id"] != host["tree_id"]


def test_script_escapes():
    assert '"<!--<script></script>-->"' in tree("<script><!--<script></script>--></script>x")
    assert '"<!--"' in tree("<script><!--</script>x")
    assert '"<!-->"' in tree("<script><!--></script>x")


def test_quirks_decide_on_tables_in_p():
    assert "<p>\n|       <table>" in tree("<p><table>")
    assert "<p>\n|     <table>" in tree("<!DOCTYPE html><p><table>")


def test_selectedcontent():
    assert tree("<select><button><selectedcontent></button><option>a<option selected>b</select>").count('"b"') == 2


def test_errors_in_order():
    codes = [e[1] for e in parse("<p>Test</p>", collect_errors=True)[1]]
    assert codes[0] == "expected-doctype-but-got-start-tag"
    _, errors = tokenize("<p a=1 'b>&#x;\n<!---->x</", collect_errors=True)
    assert [e[0] for e in errors] == ["unexpected-character-in-attribute-name", "absence-of-digits-in-numeric-character-reference", "eof-before-tag-name"]
    assert errors[0][1:] == (1, 8) and errors[2][1] == 2
    assert parse("<!DOCTYPE html><title></title>x", collect_errors=True)[1] == []


@pytest.mark.parametrize("html", ["<!DOCTYPE", "<!DOCTYPE>", "<!DOCTYPE html x>", "<!DOCTYPE html PUBLIC", "<!DOCTYPE html PUBLIC 'a", "<!DOCTYPE html SYSTEM \"a\" x>", "<!doctypehtml>"])
def test_doctypes_end(html):
    kinds = [t[0] for t in tokenize(html)[0]]
    assert kinds == ["doctype", "eof"]


def test_tokens():
    got = [(t[0], t[1], t[4]) for t in tokenize("<P a=b/>x<!--c--></p>")[0]]
    assert got == [("start", "p", None), ("character", None, "x"), ("comment", None, "c"), ("end", "p", None), ("eof", None, None)]
    assert tokenize("<p/>")[0][0][3] is True and tokenize("<p x=/>")[0][0][2] == {"x": "/"}


def test_xml_coercion():
    assert tree("a\fb﷐<!--x--y-->", xml_coercion=True).split("\n")[3:] == ['|     "a b�"', "|     <!-- x- -y -->"]


PIECES = ["<p>", "</p>", "<b>", "</b>", "<i>", "</i>", "<a href=x>", "</a>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<li>", "<ul>", "</ul>", "<select>", "<option>", "</select>", "<svg>", "</svg>", "<math>", "<mi>", "<template>", "</template>", "<script>", "</script>", "<!--", "-->", "x", " ", "\n", "&amp", "&#1;", "<title>", "</title>", "<form>", "</form>", "<h1>", "</h1>", "<nobr>", "<button>", "<frameset>", "<body>", "<head>", "</body>", "</html>", "<caption>", "<col>", "<input type=hidden>", "\0", "<foreignObject>", "<div", "=", "'", ">", "<![CDATA[", "]]>", "<plaintext>", "<noscript>", "<textarea>", "</br>", "<annotation-xml encoding=text/html>", "<font color=x>"]


@pytest.mark.parametrize("seed", range(40))
def test_random_pages_keep_the_invariants(seed):
    rng = random.Random(seed)
    for _ in range(25):
        html = "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 60)))
        context = rng.choice([None, None, ("div", None), ("table", None), ("select", None), ("template", None), ("svg", "svg"), ("td", None)])
        root = parse(html, context, collect_errors=True)[0]
        nodes, rows = number(root)
        assert len(nodes) == sum(1 for _ in walk(root)) and rows[0]["last_pre"] == len(rows) - 1
        for node, r in zip(nodes, rows, strict=True):
            assert all(c.parent is node for c in node.children), html
            assert r["parent_id"] is None or rows[r["parent_id"]]["node_id"] < r["node_id"] <= rows[r["parent_id"]]["last_pre"]
        if context is None:
            assert sum(1 for c in root.children if c.kind == "element") == 1, html


def test_deep_nesting():
    n = 20_000
    root = parse("<div>" * n + "x")[0]
    assert to_text(root) == "x" and len(number(root)[1]) == n + 5
    assert len(parse("<b><p>" * 300 + "x")[0].children) == 1
