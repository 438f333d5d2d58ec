"""Outputs, references, encodings and selectors inside one document."""

import pytest

from pagegrain.functions import encoding, output
from pagegrain.functions.nodeset import number
from pagegrain.functions.tables import C1, LEGACY, NAMED
from pagegrain.functions.tree import Node, parse
from pagegrain.plans.selectors import SelectorError, match_rows, parse_selector


def md(html):
    return output.to_markdown(parse(html)[0])


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<p><strong>Hello</strong>, World!</p>", "**Hello**, World!"),
        ("<h2>a</h2><p>b</p>", "## a\n\nb"),
        ("<a href=/x>t</a><img src=s alt=l>", "[t](/x)![l](s)"),
        ("<pre>a\n  b</pre>", "```\na\n  b\n```"),
        ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n> \n> b"),
        ("<ol><li>a</li><li>b<ul><li>c</li></ul></li></ol>", "1. a\n2. b\n\n\n  - c"),
        ("<table><tr><th>ab<th>c<tr><td>1</table>", "| ab  | c   |\n| --- | --- |\n| 1   |     |"),
        ("a<br>b<hr>c", "a  \nb\n\n---\n\nc"),
        ("<del>x</del><code>y</code><script>z</script>", "~~x~~`y`"),
    ],
)
def test_markdown(html, expected):
    assert md(html) == expected


def test_html_output():
    root = parse("<!DOCTYPE html><p class='a b' id=x title='say \"hi\"' data-e=''>a &lt; b</p><br><!--c-->")[0]
    assert output.to_html(root, pretty=False) == "<!DOCTYPE html><html><head></head><body><p class=\"a b\" data-e id=x title='say \"hi\"'>a &lt; b</p><br><!--c--></body></html>"
    assert output.to_html(root).split("\n")[4] == "    <p class=\"a b\" data-e id=x title='say \"hi\"'>a &lt; b</p>"
    assert output.to_html(parse("<pre>a\n b</pre>")[0]).split("\n")[3].strip() == "<pre>a b</pre>"


def test_text_options():
    root = parse("<p> a </p><p>b  c</p><template>no</template><style>s</style>")[0]
    assert output.to_text(root) == "a b cs"
    assert output.to_text(root, separator="|", strip=True) == "a|b c|s"
    assert output.to_text(root, separator="|", strip=True, collapse=False) == "a|b  c|s"


def test_references():
    assert output.decode_entities("Hello &amp World") == "Hello & World"
    assert output.decode_entities("foo&ampbar", in_attribute=True) == "foo&ampbar"
    assert output.decode_entities("&notinx; &#x41;&#66 &#; &; &") == "¬inx; AB &#; &; &"
    assert [output.decode_numeric_entity("65"), output.decode_numeric_entity("41", True), output.decode_numeric_entity("0"), output.decode_numeric_entity("128")] == ["A", "A", "�", "€"]
    assert len(NAMED) == 2125 and len(LEGACY) == 106 and len(C1) == 27


@pytest.mark.parametrize(
    ("data", "transport", "name"),
    [
        (b"\xef\xbb\xbfx", None, "utf-8"),
        ("﻿x".encode("utf-16-le"), None, "utf-16le"),
        (b"<meta charset='UTF-8'>", None, "utf-8"),
        (b"<meta charset=utf-16>", None, "utf-8"),
        (b"<!-- <meta charset=utf-8> --><p>", None, "windows-1252"),
        (b"<!-- <meta charset=utf-8>", None, "windows-1252"),
        (b"<meta http-equiv=content-type content='text/html; charset=EUC-JP'>", None, "euc-jp"),
        (b"<meta content='charset=euc-jp'>", None, "windows-1252"),
        (b"<p title='<meta charset=utf-8>'>", None, "windows-1252"),
        (b"x" * 2000 + b"<meta charset=utf-8>", None, "windows-1252"),
        (b"\xef\xbb\xbfx", "latin2", "iso-8859-2"),
        (b"x", "no-such-label", "windows-1252"),
        (b"x", "utf-7", "windows-1252"),
    ],
)
def test_sniff(data, transport, name):
    assert encoding.sniff(data, transport)[0] == name


def test_decode():
    assert encoding.decode_html("﻿UTF-16 Test".encode("utf-16-be"))[:2] == ("UTF-16 Test", "utf-16be")
    assert encoding.decode_html(b"\x80\x81") == ("€\x81", "windows-1252", False)
    assert encoding.decode_html(b"\xff", "utf-8") == ("", "utf-8", True)
    assert encoding.decode_html("﻿a".encode(), "utf-8")[0] == "﻿a"


def ids(html, selector):
    nodes, rows = number(parse(html)[0])
    return [output.to_text(nodes[i]) for i in match_rows(rows, parse_selector(selector))]


@pytest.mark.parametrize(
    ("html", "selector", "expected"),
    [
        ("<div><span>Direct</span><p><span>Nested</span></p></div>", "div > span", ["Direct"]),
        ("<div><p>First</p><span>Second</span><span>Third</span></div>", "p + span", ["Second"]),
        ("<div><p>First</p><span>Second</span><span>Third</span></div>", "p ~ span", ["Second", "Third"]),
        ("<ul><li>1<li>2<li>3<li>4<li>5<li>6</ul>", "li:nth-child(3n)", ["3", "6"]),
        ("<ul><li>1<li>2<li>3<li>4</ul>", "li:nth-child(-n+2)", ["1", "2"]),
        ("<ul><li>1<li>2<li>3<li>4</ul>", "li:nth-last-child(ODD)", ["2", "4"]),
        ("<p class=skip>a<p>Keep<p class='skip x'>b", "p:not(.skip)", ["Keep"]),
        ("<div id=container><ul class=list><li class=item>One<li class='item active'>Two</ul></div>", "#container .list > .item.active", ["Two"]),
        ("<p lang=en-US>a<p lang=en>b<p lang=eng>c", "[lang|=en]", ["a", "b"]),
        ("<p data-x='a b'>1<p data-x='ab'>2", "[data-x~=a]", ["1"]),
        ("<a href=http://A>1</a><a href=x>2</a>", "a[href^='HTTP' i], a[href$=x]", ["1", "2"]),
        ("<i>1</i><b>2</b><i>3</i>", "i:last-of-type, b:only-of-type", ["2", "3"]),
        ("<p></p><p><!--c--></p><p> </p>", "p:empty", ["", ""]),
        ("<p>x", "p::before", []),
    ],
)
def test_selectors(html, selector, expected):
    assert ids(html, selector) == expected


@pytest.mark.parametrize("selector", ["", "p[", "p:nope", "p:not(", ":nth-child(x)", "p >", "p[a='b]", "#"])
def test_selector_errors(selector):
    with pytest.raises(SelectorError):
        parse_selector(selector)


def test_mutation():
    root = parse("<div><p>a</p><p>b</p></div>")[0]
    div = root.children[0].children[1].children[0]
    a, b = div.children
    new = Node("element", "i", "html")
    div.insert_before(new, b)
    div.insert_before(Node("element", "u", "html"), new.clone_node())
    assert [c.name for c in div.children] == ["p", "i", "p"]
    assert div.replace_child(Node("element", "b", "html"), new) is new and div.replace_child(new, new) is None
    div.remove_child(a)
    div.remove_child(a)
    div.append_child(a.clone_node(deep=True))
    assert [c.name for c in div.children] == ["b", "p", "p"] and output.to_text(div) == "ba"
    assert div.has_child_nodes() and not new.has_child_nodes()
