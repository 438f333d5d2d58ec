"""SQL functions: scalar UDFs over Arrow batches and table functions for LATERAL joins."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pagegrain.functions import encoding, output
from pagegrain.functions.nodeset import number
from pagegrain.functions.tokenizer import tokenize
from pagegrain.functions.tree import parse
from pagegrain.plans.selectors import match_rows, needs_positions, parse_selector
from pagegrain.runtime import ship_package


NODE_COLUMNS = {
    "node_id": "int", "last_pre": "int", "parent_id": "int", "host_id": "int", "tree_id": "int", "depth": "int", "sib_idx": "int", "kind": "string", "name": "string", "ns": "string", "attrs": "map<string,string>", "data": "string",
    "elem_idx": "int", "elem_cnt": "int", "type_idx": "int", "type_cnt": "int", "prev_elem_id": "int", "parent_elem_cnt": "int", "is_empty": "boolean", "parent_name": "string",
}


def _context(context: str | None) -> tuple[str, str | None] | None:
    """The context of a fragment: a name, or "svg name" and "math name"."""
    if not context:
        return None
    ns, _, name = context.rpartition(" ")
    return name, ns or None


class ParseHtml:
    """parse_html(html[, context[, scripting[, strict]]]): the nodes of a page or fragment."""

    def eval(self, html: str, context: str = None, scripting: bool = False, strict: bool = False):
        for r in number(parse(html, _context(context), scripting=bool(scripting), strict=bool(strict))[0])[1] if html is not None else ():
            yield tuple(r[c] for c in NODE_COLUMNS)


class TokenizeHtml:
    """tokenize_html(html): the tokens of a page."""

    def eval(self, html: str):
        for i, t in enumerate(tokenize(html)[0] if html is not None else ()):
            yield i, t[0], t[1], t[2], t[4]


class HtmlEvents:
    """html_events(html): the events of a page, no tag implied."""

    def eval(self, html: str):
        for i, t in enumerate(t for t in (tokenize(html)[0] if html is not None else ()) if t[0] != "eof"):
            yield i, "text" if t[0] == "character" else t[0], t[1], t[2], t[4], t[5], t[6]


class HtmlErrors:
    """html_errors(html[, context]): the errors of a parse."""

    def eval(self, html: str, context: str = None):
        for i, e in enumerate(parse(html, _context(context), collect_errors=True)[1] if html is not None else ()):
            yield i, *e, str(e)


class HtmlSelect:
    """html_select(html, selector): the matches in a page, with attributes and text."""

    def eval(self, html: str, selector: str):
        if html is None or selector is None:
            return
        group = parse_selector(selector)
        tree, rows = number(parse(html)[0], needs_positions(group))
        for k, i in enumerate(match_rows(rows, group)):
            yield k, i, tree[i].name, tree[i].attrs, output.to_text(tree[i])


def resolve_url(base: Column, link: Column) -> Column:
    """A link in full, as a page at ``base`` means it; null without one of them."""

    @F.pandas_udf("string")
    def f(b: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([_join(u, v) for u, v in zip(b, x, strict=True)], dtype=object)

    return f(base, link)


def _join(base: str | None, link: str | None) -> str | None:
    try:
        return None if base is None or link is None else urljoin(base, link)
    except ValueError:  # such a link has no meaning
        return link


def register(spark: SparkSession) -> None:
    """Make the functions known to spark.sql under their names."""
    ship_package(spark)

    def scalar(name: str, one, kind: str = "string") -> None:
        @F.pandas_udf(kind)
        def f(column: pd.Series) -> pd.Series:
            return column.map(one, na_action="ignore")

        spark.udf.register(name, f)

    scalar("html_to_text", lambda h: output.to_text(parse(h)[0]))
    scalar("html_to_markdown", lambda h: output.to_markdown(parse(h)[0]))
    scalar("html_to_html", lambda h: output.to_html(parse(h)[0]))
    scalar("html_test_format", lambda h: output.to_test_format(parse(h)[0]))
    scalar("decode_entities", output.decode_entities)
    scalar("decode_entities_in_attribute", lambda s: output.decode_entities(s, True))
    scalar("decode_numeric_entity", output.decode_numeric_entity)
    scalar("decode_hex_entity", lambda s: output.decode_numeric_entity(s, True))
    scalar("normalize_encoding_label", encoding.normalize_label)
    scalar("sniff_html_encoding", lambda b: encoding.sniff(bytes(b))[0])
    scalar("decode_html_bytes", lambda b: encoding.decode_html(bytes(b))[0])
    def relation(name: str, f: type, columns: str) -> None:
        spark.udtf.register(name, F.udtf(f, returnType=columns))

    relation("parse_html", ParseHtml, ", ".join(f"{c} {t}" for c, t in NODE_COLUMNS.items()))
    relation("tokenize_html", TokenizeHtml, "seq int, kind string, name string, attrs map<string,string>, data string")
    relation("html_events", HtmlEvents, "seq int, kind string, name string, attrs map<string,string>, data string, public_id string, system_id string")
    relation("html_errors", HtmlErrors, "seq int, source string, code string, line int, column int, description string")
    relation("html_select", HtmlSelect, "match int, node_id int, name string, attrs map<string,string>, text string")
