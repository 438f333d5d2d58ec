"""A tree as rows: numbers, intervals and positions of its nodes, from one iterative walk."""

from __future__ import annotations

from pagegrain.functions.tree import Node

#: Columns of the nodes relation that hold positions among siblings; the others come first.
POSITIONS = ("elem_idx", "elem_cnt", "type_idx", "type_cnt", "prev_elem_id", "parent_elem_cnt")
#: Columns of the nodes relation, in order.
COLUMNS = ("node_id", "last_pre", "parent_id", "host_id", "tree_id", "depth", "sib_idx", "kind", "name", "ns", "attrs", "data", "doctype", *POSITIONS, "is_empty", "parent_name")


def _is_empty(node: Node) -> bool:
    return not node.children or all(c.kind == "comment" for c in node.children)


def number(root: Node, positions: bool = True) -> tuple[list[Node], list[dict]]:
    """Nodes in traversal order (a node, its children, then its template contents) and a row for each.

    [node_id, last_pre] covers everything below a node, template contents included; tree_id is the parentless root of the node's
    own tree, so an ancestor test is the interval and an equal tree_id. elem_* count element siblings from 1, type_* those of
    the same name; without ``positions`` rows lack those columns.
    """
    nodes: list[Node] = []
    rows: list[dict] = []
    open_: list[dict] = []  # rows whose nodes may go on
    work: list[tuple] = [(root, None, None, 0, 0, 0)]
    while work:
        node, parent, host, tree, depth, at = work.pop()
        me = len(rows)
        while open_ and open_[-1]["depth"] >= depth:
            open_.pop()["last_pre"] = me - 1
        if parent is None:
            tree = me
        up = node.parent
        row = {"node_id": me, "last_pre": me, "parent_id": parent, "host_id": host, "tree_id": tree, "depth": depth, "sib_idx": at, "kind": node.kind, "name": node.name, "ns": node.ns, "attrs": node.attrs, "data": node.data, "doctype": node.ids, "is_empty": _is_empty(node), "parent_name": up.name if up is not None else None}
        nodes.append(node)
        rows.append(row)
        if node.content is not None:
            work.append((node.content, None, me, 0, depth + 1, 0))
        children = node.children
        if children:
            k = len(children)
            for c in reversed(children):
                k -= 1
                work.append((c, me, None, tree, depth + 1, k))
        if children or node.content is not None:
            open_.append(row)
    for row in open_:
        row["last_pre"] = len(rows) - 1
    if positions:
        _positions(rows)
    return nodes, rows


def _positions(rows: list[dict]) -> None:
    totals: dict[int | None, int] = {}
    types: dict[tuple, int] = {}
    last: dict[int | None, int] = {}
    for row in rows:
        parent = row["parent_id"]
        row["elem_idx"] = row["type_idx"] = None
        row["prev_elem_id"] = last.get(parent) if parent is not None else None
        if row["kind"] == "element" and parent is not None:
            row["elem_idx"] = totals[parent] = totals.get(parent, 0) + 1
            same = parent, row["name"]
            row["type_idx"] = types[same] = types.get(same, 0) + 1
            last[parent] = row["node_id"]
    for row in rows:
        parent, counted = row["parent_id"], row["elem_idx"] is not None
        row["elem_cnt"] = totals[parent] if counted else None
        row["type_cnt"] = types[parent, row["name"]] if counted else None
        row["parent_elem_cnt"] = totals.get(parent, 0) if parent is not None else None
