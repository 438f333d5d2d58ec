"""Edits of pages by selector: remove, append, insert before, replace, clone. One pass, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.functions.nodeset import number
from pagegrain.functions.output import to_html
from pagegrain.functions.tree import Node, parse
from pagegrain.plans.selectors import match_rows, parse_selector
from pagegrain.runtime import ship_package


class Edit(NamedTuple):
    """``action``: remove, append, insert_before, replace, or clone (a deep copy behind each match)."""

    action: str
    selector: str
    html: str = ""


def fragment_nodes(html: str, context: str) -> list[Node]:
    """The top nodes of a fragment, without its wrapper."""
    return parse(html, (context, None))[0].children[0].children


def apply_edit(root: Node, edit: Edit) -> None:
    tree, rows = number(root)
    for i in match_rows(rows, parse_selector(edit.selector)):
        node = tree[i]
        parent = node.parent
        if edit.action == "append":
            for new in list(fragment_nodes(edit.html, node.name)):
                node.append_child(new)
            continue
        if parent is None:
            continue
        if edit.action == "remove":
            parent.remove_child(node)
        elif edit.action == "insert_before":
            for new in list(fragment_nodes(edit.html, parent.name)):
                parent.insert_before(new, node)
        elif edit.action == "replace":
            new = list(fragment_nodes(edit.html, parent.name))
            for n in new[:-1]:
                parent.insert_before(n, node)
            if new:
                parent.replace_child(new[-1], node)
            else:
                parent.remove_child(node)
        elif edit.action == "clone":
            at = next(k for k, c in enumerate(parent.children) if c is node)
            after = parent.children[at + 1] if at + 1 < len(parent.children) else None
            parent.insert_before(node.clone_node(deep=True), after)
        else:
            raise ValueError(f"unknown edit {edit.action!r}")


def edit_pages(df: DataFrame, edits: list[Edit], column: str = "html", key: str = "doc_id", pretty: bool = False) -> DataFrame:
    """(key, html) of pages after the edits, which are made one after another; null pages stay null."""
    ship_package(df.sparkSession)
    for e in edits:
        parse_selector(e.selector)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page in b["page"].to_pylist():
                if page is None:
                    out.append(None)
                    continue
                root = parse(page)[0]
                for e in edits:
                    apply_edit(root, e)
                out.append(to_html(root, pretty))
            yield pa.RecordBatch.from_arrays([b["k"], pa.array(out, pa.string())], names=[key, "html"])

    return df.select(F.col(key).alias("k"), F.col(column).alias("page")).mapInArrow(run, f"`{key}` {kind.simpleString()}, html string")
