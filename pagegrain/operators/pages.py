"""Relations from a column of HTML: nodes, tokens, events, errors, matches of selectors, and texts.

Every operator is one pass over the rows with Arrow batches and no shuffle; the unit of work is a document. Filter documents
before: no condition passes through Python. ``content`` may be binary, then its encoding is found first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from pagegrain.functions.encoding import decode_html
from pagegrain.functions.nodeset import POSITIONS, number
from pagegrain.functions.output import to_html, to_markdown, to_test_format, to_text
from pagegrain.functions.tokenizer import tokenize
from pagegrain.functions.tree import Node, StrictModeError, parse
from pagegrain.plans.selectors import match_rows, needs_positions, parse_selector
from pagegrain.runtime import ship_package

TEXT, INT, LONG, BOOL = pa.string(), pa.int32(), pa.int64(), pa.bool_()
ATTRS = pa.map_(TEXT, TEXT)
DOCTYPE = pa.struct([("name", TEXT), ("public_id", TEXT), ("system_id", TEXT), ("force_quirks", BOOL)])
_DDL = {TEXT: "string", INT: "int", LONG: "bigint", BOOL: "boolean", ATTRS: "map<string,string>", DOCTYPE: "struct<name:string,public_id:string,system_id:string,force_quirks:boolean>"}

NODES = {
    "node_id": INT, "last_pre": INT, "parent_id": INT, "host_id": INT, "tree_id": INT, "depth": INT, "sib_idx": INT, "kind": TEXT,
    "name": TEXT, "ns": TEXT, "attrs": ATTRS, "data": TEXT, "doctype": DOCTYPE, "elem_idx": INT, "elem_cnt": INT, "type_idx": INT,
    "type_cnt": INT, "prev_elem_id": INT, "parent_elem_cnt": INT, "is_empty": BOOL, "parent_name": TEXT,
}
TOKENS = {"seq": INT, "kind": TEXT, "name": TEXT, "attrs": ATTRS, "self_closing": BOOL, "data": TEXT, "public_id": TEXT, "system_id": TEXT, "force_quirks": BOOL}
EVENTS = {"seq": INT, "kind": TEXT, "name": TEXT, "attrs": ATTRS, "data": TEXT, "public_id": TEXT, "system_id": TEXT}
ERRORS = {"seq": INT, "source": TEXT, "code": TEXT, "line": INT, "column": INT}
MATCHES = {"match": INT, "node_id": INT, "name": TEXT, "attrs": ATTRS, "text": TEXT}

DOCUMENTS = {"encoding": TEXT, "failed": BOOL, "root": TEXT, "context": TEXT, "n_nodes": INT, "n_errors": INT, "errors": pa.list_(pa.struct([("source", TEXT), ("code", TEXT), ("line", INT), ("column", INT)]))}
_DDL[DOCUMENTS["errors"]] = "array<struct<source:string,code:string,line:int,column:int>>"

#: Rows that a batch holds before it is handed to Spark.
BATCH = 20_000


class Page:
    """A page as text, with the encoding that was found for bytes (None for text) and whether the bytes couldn't be decoded."""

    __slots__ = ("text", "encoding", "failed")

    def __init__(self, page: str | bytes, label: str | None):
        self.text, self.encoding, self.failed = decode_html(page, label) if isinstance(page, bytes) else (page, None, False)


def _relation(df: DataFrame, column: str, fields: dict[str, pa.DataType], columns_of: Callable[[Page], list[list]], key: str, transport: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, *keep, *fields) for the columns that ``columns_of`` gives for a page; null pages have no rows."""
    ship_package(df.sparkSession)
    kinds: dict[str, DataType] = {c: df.schema[c].dataType for c in (key, *keep)}
    read = df.select(F.col(column).alias("page"), (F.col(transport) if transport else F.lit(None).cast("string")).alias("label"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            counts: list[int] = []
            columns: list[list] = [[] for _ in fields]

            def out(batch=batch, at=at, counts=counts, columns=columns) -> pa.RecordBatch:
                take = pa.array(np.repeat(np.array(at, np.int64), counts))
                arrays = [*(batch[f"k{i}"].take(take) for i in range(len(kinds))), *(pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True))]
                for held in (at, counts, *columns):
                    held.clear()
                return pa.RecordBatch.from_arrays(arrays, names=[*kinds, *fields])

            for i, (page, label) in enumerate(zip(batch["page"].to_pylist(), batch["label"].to_pylist(), strict=True)):
                if page is None:
                    continue
                found = columns_of(Page(page, label))
                at.append(i)
                counts.append(len(found[0]))
                for c, v in zip(columns, found, strict=True):
                    c += v
                if len(columns[0]) > BATCH:
                    yield out()
            yield out()

    ddl = ", ".join([*(f"`{c}` {t.simpleString()}" for c, t in kinds.items()), *(f"`{n}` {_DDL[t]}" for n, t in fields.items())])
    return read.mapInArrow(run, ddl)


def _attrs(a: dict | None) -> list | None:
    return None if a is None else list(a.items())


def _doctype(ids: tuple | None) -> dict | None:
    return None if ids is None else dict(zip(("name", "public_id", "system_id", "force_quirks"), ids, strict=True))


def _turned(rows: list[tuple], width: int) -> list[list]:
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(width)]


def _node_columns(rows: list[dict], columns: tuple[str, ...]) -> list[list]:
    return [[_attrs(r[c]) for r in rows] if c == "attrs" else [_doctype(r[c]) for r in rows] if c == "doctype" else [r[c] for r in rows] for c in columns]


def nodes(df: DataFrame, column: str = "html", key: str = "doc_id", columns: tuple[str, ...] = tuple(NODES), where: str | None = None, keep: tuple[str, ...] = (), transport: str | None = None, **options) -> DataFrame:
    """The nodes relation; ``columns`` names those that are needed, the others aren't built.

    Of ``where``, a selector, only the matches leave the parse. ``keep``: columns of ``df`` that each node carries. Options are
    those of a parse.
    """
    group = parse_selector(where) if where else None
    positions = not set(columns).isdisjoint(POSITIONS) or group is not None and needs_positions(group)

    def columns_of(page: Page) -> list[list]:
        rows = number(parse(page.text, **options)[0], positions)[1]
        return _node_columns(rows if group is None else [rows[i] for i in match_rows(rows, group)], columns)

    return _relation(df, column, {c: NODES[c] for c in columns}, columns_of, key, transport, keep)


def documents(df: DataFrame, column: str = "html", key: str = "doc_id", keep: tuple[str, ...] = (), transport: str | None = None, **options) -> DataFrame:
    """A row for each page: the encoding found (of bytes), the kind of its root, a fragment's context, nodes, and all parse errors."""
    context = (options.get("context") or (None,))[0]

    def columns_of(page: Page) -> list[list]:
        root, errors = parse(page.text, collect_errors=True, **options)
        found = [dict(zip(("source", "code", "line", "column"), e, strict=True)) for e in errors]
        return [[page.encoding], [page.failed], [root.name], [context], [len(number(root, False)[0])], [len(found)], [found]]

    return _relation(df, column, DOCUMENTS, columns_of, key, transport, keep)


def tokens(df: DataFrame, column: str = "html", key: str = "doc_id", keep: tuple[str, ...] = (), transport: str | None = None, **options) -> DataFrame:
    def columns_of(page: Page) -> list[list]:
        return _turned([(i, kind, name, _attrs(attrs), closing, data, public, system, quirks) for i, (kind, name, attrs, closing, data, public, system, quirks) in enumerate(tokenize(page.text, **options)[0])], len(TOKENS))

    return _relation(df, column, TOKENS, columns_of, key, transport, keep)


def event_list(page: str) -> list[tuple]:
    """Start, end, text, comment and doctype events; no tree is built, so no tag is implied."""
    kinds = {"character": "text"}
    return [(i, kinds.get(t[0], t[0]), t[1], t[2], t[4], t[5], t[6]) for i, t in enumerate(t for t in tokenize(page)[0] if t[0] != "eof")]


def html_events(df: DataFrame, column: str = "html", key: str = "doc_id", keep: tuple[str, ...] = (), transport: str | None = None) -> DataFrame:
    """The events of pages; of bytes after their encoding is found, with the label that ``transport`` names where it is not null."""

    def columns_of(page: Page) -> list[list]:
        return _turned([(seq, kind, name, _attrs(attrs), data, public, system) for seq, kind, name, attrs, data, public, system in event_list(page.text)], len(EVENTS))

    return _relation(df, column, EVENTS, columns_of, key, transport, keep)


def parse_errors(df: DataFrame, column: str = "html", key: str = "doc_id", keep: tuple[str, ...] = (), transport: str | None = None, **options) -> DataFrame:
    """Errors of the scanner, then those of the tree builder, which have no place."""

    def columns_of(page: Page) -> list[list]:
        return _turned([(i, source, code, line, col) for i, (source, code, line, col) in enumerate(parse(page.text, collect_errors=True, **options)[1])], len(ERRORS))

    return _relation(df, column, ERRORS, columns_of, key, transport, keep)


def strict_status(df: DataFrame, column: str = "html", key: str = "doc_id", keep: tuple[str, ...] = (), transport: str | None = None, **options) -> DataFrame:
    """(key, *keep, status): the error that a strict parse of a page would end with, described; null for pages without errors.

    A job that has to fail on the first page with an error passes ``strict=True`` to any other operator.
    """

    def columns_of(page: Page) -> list[list]:
        try:
            parse(page.text, strict=True, **options)
        except StrictModeError as e:
            return [[str(e.error)]]
        return [[None]]

    return _relation(df, column, {"status": TEXT}, columns_of, key, transport, keep)


def own_text() -> Column:
    """A node's own text: the data of a text node, of any other node the empty string."""
    return F.when(F.col("kind") == "text", F.col("data")).otherwise(F.lit(""))


def describe_errors(errors: DataFrame) -> DataFrame:
    """With a column ``description``: (line,column): code, or the code alone."""
    return errors.withColumn("description", F.when(F.col("line").isNull(), F.col("code")).otherwise(F.format_string("(%d,%d): %s", "line", "column", "code")))


def matches(
    df: DataFrame, selector: str, column: str = "html", key: str = "doc_id", separator: str = "", strip: bool = False, collapse: bool = True, first: bool = False, keep: tuple[str, ...] = (), extra: tuple[str, ...] = (), transport: str | None = None, **options
) -> DataFrame:
    """Nodes that match a selector, with attributes and text: parse, match and read in one pass, without a join.

    ``keep``: columns of ``df`` that each match carries; ``extra``: further columns of the nodes relation. For many selectors over
    the same pages build ``nodes`` once and use ``plans.selectors.select``, or count with ``match_counts``.
    """
    group = parse_selector(selector)
    positions = needs_positions(group) or not set(extra).isdisjoint(POSITIONS)

    def columns_of(page: Page) -> list[list]:
        tree, rows = number(parse(page.text, **options)[0], positions)
        found = match_rows(rows, group)[: 1 if first else None]
        own = [list(range(len(found))), found, [tree[i].name for i in found], [_attrs(tree[i].attrs) for i in found], [to_text(tree[i], separator, strip, collapse) for i in found]]
        return own + _node_columns([rows[i] for i in found], extra)

    return _relation(df, column, {**MATCHES, **{c: NODES[c] for c in extra}}, columns_of, key, transport, keep)


def match_counts(df: DataFrame, selectors: dict[str, str], column: str = "html", key: str = "doc_id", keep: tuple[str, ...] = (), transport: str | None = None, **options) -> DataFrame:
    """A row for each page with the number of matches of each selector, by the selectors' names: one parse for all of them."""
    groups = [parse_selector(s) for s in selectors.values()]
    positions = any(map(needs_positions, groups))

    def columns_of(page: Page) -> list[list]:
        rows = number(parse(page.text, **options)[0], positions)[1]
        return [[len(match_rows(rows, g))] for g in groups]

    return _relation(df, column, dict.fromkeys(selectors, LONG), columns_of, key, transport, keep)


def _rendered(df: DataFrame, name: str, render: Callable[[Node], str], column: str, key: str, keep: tuple[str, ...], transport: str | None, options: dict) -> DataFrame:
    return _relation(df, column, {name: TEXT}, lambda page: [[render(parse(page.text, **options)[0])]], key, transport, keep)


def page_text(df: DataFrame, column: str = "html", key: str = "doc_id", separator: str = "", strip: bool = False, collapse: bool = True, keep: tuple[str, ...] = (), transport: str | None = None, **options) -> DataFrame:
    return _rendered(df, "text", lambda n: to_text(n, separator, strip, collapse), column, key, keep, transport, options)


def page_html(df: DataFrame, column: str = "html", key: str = "doc_id", pretty: bool = True, indent: int = 2, keep: tuple[str, ...] = (), transport: str | None = None, **options) -> DataFrame:
    return _rendered(df, "html", lambda n: to_html(n, pretty, indent), column, key, keep, transport, options)


def page_markdown(df: DataFrame, column: str = "html", key: str = "doc_id", keep: tuple[str, ...] = (), transport: str | None = None, **options) -> DataFrame:
    return _rendered(df, "markdown", to_markdown, column, key, keep, transport, options)


def page_test_format(df: DataFrame, column: str = "html", key: str = "doc_id", keep: tuple[str, ...] = (), transport: str | None = None, **options) -> DataFrame:
    return _rendered(df, "dump", to_test_format, column, key, keep, transport, options)


def decoded(df: DataFrame, column: str = "content", key: str = "doc_id", transport: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, text, encoding, failed) of pages that are bytes; null pages keep a row of nulls."""
    found = _relation(df.filter(F.col(column).isNotNull()), column, {"text": TEXT, "encoding": TEXT, "failed": BOOL}, lambda page: [[page.text], [page.encoding], [page.failed]], key, transport, keep)
    none = [F.lit(None).cast(t).alias(n) for n, t in (("text", "string"), ("encoding", "string"), ("failed", "boolean"))]
    return found.union(df.filter(F.col(column).isNull()).select(key, *keep, *none))


def subtree_text(found: DataFrame, all_nodes: DataFrame, separator: str = "", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, node_id, *carry, text) of nodes of the relation, with built-in functions alone: the texts of their intervals in order."""
    texts = all_nodes.filter("kind = 'text'").select(F.col("doc_id").alias("t_doc"), F.col("tree_id").alias("t_tree"), F.col("node_id").alias("t_node"), "data")
    keys = found.select("doc_id", "tree_id", "node_id", "last_pre", *carry)
    on = (F.col("t_doc") == F.col("doc_id")) & (F.col("t_tree") == F.col("tree_id")) & F.col("t_node").between(F.col("node_id"), F.col("last_pre"))
    joined = keys.join(texts, on, "left").groupBy("doc_id", "node_id", *carry).agg(F.array_sort(F.collect_list(F.struct("t_node", "data"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["data"]), separator)
    return joined.select("doc_id", "node_id", *carry, F.trim(F.regexp_replace(text, r"(?U)\s+", " ")).alias("text"))
