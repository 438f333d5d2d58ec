"""Text, HTML, Markdown and the canonical dump of a tree. All walks are iterative."""

from __future__ import annotations

import re
from collections.abc import Callable

from pagegrain.functions.tables import LEGACY, LONGEST_LEGACY, NAMED, VOID, numeric_reference
from pagegrain.functions.tree import Node, walk

_BLANK = re.compile(r"\s+")


def own_children(node: Node) -> list[Node]:
    return node.content.children if node.content is not None else node.children


def texts_below(node: Node) -> list[str]:
    """The data of all text nodes below a node in order, not entering template contents."""
    out, work = [], [node]
    while work:
        n = work.pop()
        if n.kind == "text":
            out.append(n.data)
        work.extend(reversed(n.children))
    return out


def to_text(node: Node, separator: str = "", strip: bool = False, collapse: bool = True) -> str:
    parts = texts_below(node)
    if strip:
        parts = [p for p in (p.strip() for p in parts) if p]
    text = separator.join(parts)
    return _BLANK.sub(" ", text).strip() if collapse else text


# --- the canonical dump -----------------------------------------------------------------------------------------------


def dump_line(kind: str, name: str, ns: str | None, data: str | None, ids: tuple | None) -> str:
    if kind == "text":
        return f'"{data}"'
    if kind == "comment":
        return f"<!-- {data} -->"
    if kind == "doctype":
        title, public, system = ids[:3]
        quoted = f' "{public or ""}" "{system or ""}"' if public is not None or system is not None else ""
        return f"<!DOCTYPE {title or ''}{quoted}>"
    return f"<{name}>" if ns in (None, "html") else f"<{ns} {name}>"


def to_test_format(root: Node) -> str:
    """One line a node and attribute, indented by depth; of a fragment the html wrapper isn't shown."""
    tops = [root]
    if root.kind == "document":
        tops = root.children
    elif root.kind == "fragment":
        tops = next((c.children for c in root.children if c.name == "html"), root.children)
    lines, work = [], [(n, 0) for n in reversed(tops)]
    while work:
        node, depth = work.pop()
        pad = "| " + " " * depth
        lines.append(pad + dump_line(node.kind, node.name, node.ns, node.data, node.ids))
        if node.kind == "element":
            lines += [f'{pad}  {k}="{v}"' for k, v in sorted(node.attrs.items())]
        if node.content is not None:
            lines.append(pad + "  content")
            work.extend((c, depth + 4) for c in reversed(node.content.children))
        else:
            work.extend((c, depth + 2) for c in reversed(node.children))
    return "\n".join(lines)


# --- HTML -------------------------------------------------------------------------------------------------------------


def escape_text(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def start_tag(name: str, attrs: dict[str, str]) -> str:
    out = [f"<{name}"]
    for key, value in sorted(attrs.items()):
        safe = value.replace("&", "&amp;")
        if not value:
            out.append(f" {key}")
        elif not re.search(r"[>\"'= \t\n\f\r]", value):
            out.append(f" {key}={safe}")
        elif '"' in value and "'" not in value:
            out.append(f" {key}='{safe}'")
        else:
            out.append(f' {key}="' + safe.replace('"', "&quot;") + '"')
    return "".join(out) + ">"


def to_html(root: Node, pretty: bool = True, indent: int = 2) -> str:
    parts: list[str] = []
    work: list[tuple[Node, int, bool]] = [(root, 0, False)]
    while work:
        node, depth, leaving = work.pop()
        pad = " " * (depth * indent) if pretty else ""
        if leaving:
            parts.append(f"{pad}</{node.name}>")
        elif node.kind == "text":
            text = node.data.strip() if pretty else node.data
            if text:
                parts.append(pad + escape_text(text))
        elif node.kind == "comment":
            parts.append(f"{pad}<!--{node.data}-->")
        elif node.kind == "doctype":
            parts.append(f"{pad}<!DOCTYPE html>")
        elif node.kind in ("document", "fragment"):
            work.extend((c, depth, False) for c in reversed(node.children))
        else:
            opening, below = pad + start_tag(node.name, node.attrs), own_children(node)
            if node.name in VOID:
                parts.append(opening)
            elif not below:
                parts.append(f"{opening}</{node.name}>")
            elif pretty and all(c.kind == "text" for c in below):
                parts.append(f"{opening}{escape_text(to_text(node))}</{node.name}>")
            else:
                parts.append(opening)
                work.append((node, depth, True))
                work.extend((c, depth + 1, False) for c in reversed(below))
    return ("\n" if pretty else "").join(parts)


# --- Markdown ---------------------------------------------------------------------------------------------------------


class _Buffer:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.waiting, self.verbatim = 0, False
        self.lists: list[int] = []  # the next number of each open list, -1 if it has none

    def flush(self) -> None:
        if self.waiting and any(self.parts):
            self.parts.append("\n" * self.waiting)
        self.waiting = 0

    def add(self, s: str) -> None:
        if any(self.parts):
            self.flush()
        self.parts.append(s)

    def lines(self, n: int) -> None:
        self.waiting = max(self.waiting, n)

    def apart(self) -> None:
        self.lines(2)
        self.flush()

    def result(self) -> str:
        return "".join(self.parts).strip()


_PLAIN = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "strike": "~~"}
_SECTIONS = frozenset("p div section article main header footer nav aside".split())
_LEFT_OUT = frozenset("title style script noscript template".split())


def to_markdown(root: Node) -> str:
    top = _Buffer()
    work: list[Callable[[], None]] = []

    def later(*steps: Callable[[], None]) -> None:
        work.extend(reversed(steps))

    def children(node: Node, b: _Buffer) -> Callable[[], None]:
        return lambda: later(*[lambda c=c: visit(c, b) for c in node.children])

    def quote(inner: _Buffer, b: _Buffer) -> None:
        b.flush()
        b.add("\n".join("> " + line for line in inner.result().split("\n")))
        b.lines(2)

    def item(node: Node, b: _Buffer) -> None:
        b.lines(1)
        b.flush()
        mark = "- "
        if b.lists and b.lists[-1] >= 0:
            mark = f"{b.lists[-1]}. "
            b.lists[-1] += 1
        b.add("  " * max(0, len(b.lists) - 1) + mark)
        later(children(node, b))

    def preformatted(node: Node, b: _Buffer) -> None:
        b.apart()
        b.add("```\n")
        before, b.verbatim = b.verbatim, True

        def close() -> None:
            b.verbatim = before
            if not "".join(b.parts[-2:]).endswith("\n"):
                b.add("\n")
            b.add("```")
            b.lines(2)

        later(children(node, b), close)

    def table(node: Node, b: _Buffer) -> None:
        b.lines(2)
        rows: list[list[_Buffer]] = []
        steps = []
        search = list(reversed(node.children))
        while search:
            n = search.pop()
            if n.name == "tr":
                cells = [c for c in n.children if c.name in ("td", "th")]
                if cells:
                    rows.append([_Buffer() for _ in cells])
                    steps += [children(c, cell) for c, cell in zip(cells, rows[-1], strict=True)]
            elif n.name in ("thead", "tbody", "tfoot"):
                search.extend(reversed(n.children))

        def close() -> None:
            if rows:
                grid = [[c.result() for c in row] for row in rows]
                n = max(map(len, grid))
                grid = [row + [""] * (n - len(row)) for row in grid]
                width = [max(3, *(len(row[i]) for row in grid)) for i in range(n)]
                b.flush()
                for k, row in enumerate([grid[0], ["-" * w for w in width], *grid[1:]]):
                    if k:
                        b.lines(1)
                        b.flush()
                    b.add("| " + " | ".join(c.ljust(w) for c, w in zip(row, width, strict=True)) + " |")
                b.lines(1)
            b.lines(2)

        later(*steps, close)

    def visit(node: Node, b: _Buffer) -> None:
        name = node.name
        if node.kind == "text":
            text = node.data if b.verbatim else _BLANK.sub(" ", node.data)
            if text or b.verbatim:
                b.add(text)
        elif node.kind in ("comment", "doctype") or name in _LEFT_OUT:
            return
        elif name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            b.apart()
            b.add("#" * int(name[1]) + " ")
            later(children(node, b), lambda: b.lines(2))
        elif name in _SECTIONS:
            b.apart()
            later(children(node, b), lambda: b.lines(2))
        elif name == "br":
            b.add("  \n")
        elif name == "hr":
            b.apart()
            b.add("---")
            b.lines(2)
        elif name in _PLAIN or name == "code" and not b.verbatim:
            mark = _PLAIN.get(name, "`")
            b.add(mark)
            later(children(node, b), lambda: b.add(mark))
        elif name == "pre":
            preformatted(node, b)
        elif name == "blockquote":
            b.lines(2)
            inner = _Buffer()
            later(children(node, inner), lambda: quote(inner, b))
        elif name == "a":
            b.add("[")
            later(children(node, b), lambda: b.add(f"]({node.attrs.get('href', '')})"))
        elif name == "img":
            b.add(f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')})")
        elif name in ("ul", "ol"):
            b.apart()
            b.lists.append(1 if name == "ol" else -1)
            later(children(node, b), lambda: (b.lists.pop(), b.lines(2)))
        elif name == "li":
            item(node, b)
        elif name == "table":
            table(node, b)
        else:
            later(children(node, b))

    visit(root, top)
    while work:
        work.pop()()
    return top.result()


# --- character references without a parse -----------------------------------------------------------------------------

_REFERENCE = re.compile(r"&(?:#(?P<hex>[xX])?(?P<digits>(?(hex)[0-9A-Fa-f]*|[0-9]*))|(?P<name>[A-Za-z0-9]+))(?P<end>;?)")


def decode_numeric_entity(digits: str, is_hex: bool = False) -> str:
    try:
        return numeric_reference(int(digits, 16 if is_hex else 10))
    except (ValueError, OverflowError):
        return "�"


def decode_entities(text: str, in_attribute: bool = False) -> str:
    """Decode the references of a text that isn't parsed. Prefixes of unknown names count outside attributes."""
    out, at = [], 0
    while True:
        amp = text.find("&", at)
        if amp < 0:
            return "".join([*out, text[at:]])
        out.append(text[at:amp])
        m = _REFERENCE.match(text, amp)
        if not m:
            out.append("&")
            at = amp + 1
            continue
        name, closed = m["name"], m["end"] == ";"
        at = m.end()
        if name is None:
            out.append(decode_numeric_entity(m["digits"], bool(m["hex"])) if m["digits"] else m[0])
            continue
        if closed and name in NAMED:
            out.append(NAMED[name])
            continue
        known = next((name[:k] for k in range(min(len(name), LONGEST_LEGACY), 0, -1) if name[:k] in LEGACY), "")
        whole = known == name
        after = text[m.end() : m.end() + 1] if not closed else ";"
        if known and (not in_attribute or whole and not (after == "=" or after.isascii() and after.isalnum())):
            out.append(NAMED[known])
            at = amp + 1 + len(known)
        elif known or not closed:
            out.append("&")
            at = amp + 1
        else:
            out.append(m[0])


def count_nodes(root: Node) -> int:
    return sum(1 for _ in walk(root))
