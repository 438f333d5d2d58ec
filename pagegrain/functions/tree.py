"""Tree construction by the rules of the HTML standard, over the scanner's tokens.

Each insertion mode is a set of methods; a method returns True when the token has to be looked at again in the mode that it set.
Nothing here is recursive, so nesting may be as deep as a text allows.
"""

from __future__ import annotations

from typing import NamedTuple

from pagegrain.functions.tables import (
    BLOCK_END,
    BLOCK_START,
    BREAKOUT,
    BUTTON_SCOPE,
    FOREIGN_ATTRIBUTES,
    FORMATTING,
    HEAD_CONTENT,
    HEADINGS,
    IMPLIED_END,
    IMPLIED_END_ALL,
    LIST_SCOPE,
    MATHML_TEXT,
    SCOPE,
    SPECIAL,
    SVG_ATTRIBUTES,
    SVG_HTML,
    SVG_NAMES,
    TABLE_PARTS,
    TABLE_SCOPE,
)
from pagegrain.functions.tokenizer import RAWTEXT, Scanner, ascii_lower

SPACE = " \t\n\r\f"
SECTIONS = frozenset(("tbody", "tfoot", "thead"))
CELLS = frozenset(("td", "th"))
TABLE_WORDS = frozenset(("table", "tbody", "tfoot", "thead", "tr"))
#: Elements that a select may hold.
IN_SELECT = frozenset("p div span button datalist selectedcontent menuitem".split())
#: Fixed beginnings of public identifiers that mean quirks mode.
QUIRKS = ("-//w3c//dtd html 3.2", "-//w3c//dtd html 4.0 transitional", "-//w3c//dtd html 4.0 frameset", "-//w3c//dtd html 4.01 transitional", "-//w3c//dtd html 4.01 frameset", "html")


#: Start tags with rules of their own in a body; formatting elements besides a and nobr have one rule.
BODY_RULES = (
    BLOCK_START | HEADINGS | HEAD_CONTENT | TABLE_PARTS | RAWTEXT
    | frozenset("a applet area body br button dd dt embed form frame frameset head hr html image img input keygen li listing marquee math nobr noscript object optgroup option param plaintext pre rb rp rt rtc select source svg table textarea track wbr".split())
)


class Node:
    __slots__ = ("kind", "name", "ns", "attrs", "data", "parent", "children", "content", "ids", "open")

    def __init__(self, kind: str, name: str, ns: str | None = None, attrs: dict[str, str] | None = None, data: str | None = None):
        self.kind, self.name, self.ns, self.attrs, self.data = kind, name, ns, attrs if attrs is not None else {}, data
        self.parent: Node | None = None
        self.children: list[Node] = []
        self.content: Node | None = None  # of an HTML template
        self.ids: tuple | None = None  # of a doctype: name, public, system, force_quirks
        self.open = False  # whether the builder's stack holds it
        if name == "template" and kind == "element" and ns == "html":
            self.content = Node("fragment", "#document-fragment")

    def append(self, child: Node) -> None:
        child.parent = self
        self.children.append(child)

    def insert(self, at: int, child: Node) -> None:
        child.parent = self
        self.children.insert(at, child)

    def detach(self) -> None:
        if self.parent is not None:
            siblings = self.parent.children
            for i in range(len(siblings) - 1, -1, -1):
                if siblings[i] is self:
                    del siblings[i]
                    break
            self.parent = None

    def append_child(self, child: Node) -> None:
        """Append without taking the child from a parent that it has."""
        self.append(child)

    def remove_child(self, child: Node) -> None:
        if any(c is child for c in self.children):
            child.detach()

    def insert_before(self, child: Node, reference: Node | None) -> None:
        """Without a reference the child goes to the end; before a node that isn't a child of this one nothing happens."""
        if reference is None:
            self.append(child)
            return
        at = next((i for i, c in enumerate(self.children) if c is reference), -1)
        if at >= 0:
            self.insert(at, child)

    def replace_child(self, new: Node, old: Node) -> Node | None:
        at = next((i for i, c in enumerate(self.children) if c is old), -1)
        if at < 0:
            return None
        self.children[at], new.parent, old.parent = new, self, None
        return old

    def clone_node(self, deep: bool = False) -> Node:
        """A copy; template contents are copied also by a shallow one."""
        if deep:
            return self.clone()
        new = self.copy()
        if self.content is not None:
            new.content = self.content.clone()
        return new

    def has_child_nodes(self) -> bool:
        return bool(self.children)

    def copy(self) -> Node:
        """This node alone, without children."""
        new = Node(self.kind, self.name, self.ns, dict(self.attrs), self.data)
        new.ids = self.ids
        return new

    def clone(self, contents: bool = True) -> Node:
        """This node with all below it; template contents only if asked for."""
        top = self.copy()
        work = [(self, top)]
        while work:
            old, new = work.pop()
            for child in old.children:
                c = child.copy()
                new.append(c)
                work.append((child, c))
            if contents and old.content is not None:
                work.append((old.content, new.content))
        return top


def walk(root: Node):
    """All nodes in traversal order: a node, its children, then its template contents."""
    work = [root]
    while work:
        node = work.pop()
        yield node
        if node.content is not None:
            work.append(node.content)
        work.extend(reversed(node.children))


class Stack(list):
    """Open elements, with the number of each name, so that no name has to be looked for in a deep stack that lacks it."""

    def __init__(self) -> None:
        self.named: dict[str, int] = {}

    def _in(self, node: Node) -> None:
        node.open = True
        self.named[node.name] = self.named.get(node.name, 0) + 1

    def _out(self, node: Node) -> None:
        node.open = False
        self.named[node.name] -= 1

    def has(self, name: str) -> bool:
        return self.named.get(name, 0) > 0

    def append(self, node: Node) -> None:
        node.open = True
        name = node.name
        self.named[name] = self.named.get(name, 0) + 1
        list.append(self, node)

    def pop(self) -> Node:
        node = list.pop(self)
        node.open = False
        self.named[node.name] -= 1
        return node

    def insert(self, at: int, node: Node) -> None:
        self._in(node)
        list.insert(self, at, node)

    def remove(self, node: Node) -> None:
        list.remove(self, node)
        self._out(node)

    def __setitem__(self, at: int, node: Node) -> None:
        self._out(self[at])
        self._in(node)
        list.__setitem__(self, at, node)

    def __delitem__(self, at: int | slice) -> None:
        for node in self[at] if isinstance(at, slice) else (self[at],):
            self._out(node)
        list.__delitem__(self, at)


class TreeBuilder:
    def __init__(self, context: tuple[str, str | None] | None = None, scripting: bool = False, iframe_srcdoc: bool = False, collect_errors: bool = False):
        self.scripting, self.srcdoc, self.collect = scripting, iframe_srcdoc, collect_errors
        self.found: list[str] = []
        self.doc = Node("fragment" if context else "document", "#document-fragment" if context else "#document")
        self.stack = Stack()
        self.formatting: list[Node | None] = []
        self.template_modes: list[str] = []
        self.head: Node | None = None
        self.form: Node | None = None
        self.quirks, self.frameset_ok, self.foster, self.skip_newline = False, True, False, False
        self.shows = False  # whether a selectedcontent element was seen
        self.mode, self.after_text, self.table_text = "initial", "in_body", []
        self.before_table_text = "in_table"
        self.scanner: Scanner | None = None
        self.context: Node | None = None
        if context:
            name, ns = context
            self.context = Node("element", name, ns or "html")
            html = Node("element", "html", "html")
            self.doc.append(html)
            self.stack.append(html)
            if name == "template":
                self.template_modes.append("in_template")
            self.mode = {"tr": "in_row", "caption": "in_caption", "colgroup": "in_column_group", "table": "in_table", "template": "in_template", "frameset": "in_frameset", "html": "before_head", **dict.fromkeys(SECTIONS, "in_table_body")}.get(name, "in_body")

    # --- the stack and places ---------------------------------------------------------------------------------------

    @property
    def namespace(self) -> str | None:
        return self.stack[-1].ns if self.stack else None

    @property
    def current(self) -> Node | None:
        return self.stack[-1] if self.stack else None

    def error(self, code: str) -> None:
        if self.collect:
            self.found.append(code)

    def is_current(self, *names: str) -> bool:
        return bool(self.stack) and self.stack[-1].name in names

    def in_scope(self, name: str, stops: frozenset = SCOPE) -> bool:
        if not self.stack.named.get(name):
            return False
        for node in reversed(self.stack):
            if node.name == name:
                return True
            if node.name in stops:
                return False
        return False

    def node_in_scope(self, target: Node) -> bool:
        if not target.open:
            return False
        for node in reversed(self.stack):
            if node is target:
                return True
            if node.name in SCOPE:
                return False
        return False

    def any_in_scope(self, names: frozenset, stops: frozenset = SCOPE) -> bool:
        for node in reversed(self.stack):
            if node.name in names:
                return True
            if node.name in stops:
                return False
        return False

    def select_in_scope(self) -> bool:
        for node in reversed(self.stack):
            if node.name == "select":
                return True
            if node.name not in ("optgroup", "option"):
                break
        return self.stack.has("select") or self.context is not None and self.context.name == "select"

    def pop_until(self, *names: str) -> None:
        while self.stack and self.stack.pop().name not in names:
            pass

    def back_to(self, names: frozenset) -> None:
        while self.stack and self.stack[-1].name not in names:
            self.stack.pop()

    def imply_ends(self, but: str | None = None, names: frozenset = IMPLIED_END) -> None:
        while self.stack and self.stack[-1].name in names and self.stack[-1].name != but:
            self.stack.pop()

    def close_p(self) -> None:
        self.imply_ends("p")
        if not self.is_current("p"):
            self.error("expected-p-end-tag")
        self.pop_until("p")

    def close_p_in_scope(self) -> None:
        if self.stack.named.get("p") and self.in_scope("p", BUTTON_SCOPE):
            self.close_p()

    def place(self, target: Node | None = None) -> tuple[Node, int | None]:
        """The parent and index for a new node; index None is the end."""
        if target is None:
            target = self.stack[-1] if self.stack else self.doc
        if self.foster and target.name in TABLE_WORDS:
            table = template = -1
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].name == "table" and table < 0:
                    table = i
                if self.stack[i].name == "template" and template < 0:
                    template = i
            if template >= 0 and template > table:
                return self.stack[template].content or self.stack[template], None
            if table < 0:
                return self.stack[0] if self.stack else self.doc, None
            node = self.stack[table]
            if node.parent is not None:
                return node.parent, next(i for i in range(len(node.parent.children) - 1, -1, -1) if node.parent.children[i] is node)
            target = self.stack[table - 1]
        return (target.content if target.content is not None else target), None

    def put(self, node: Node, where: tuple[Node, int | None]) -> None:
        parent, at = where
        if at is None:
            parent.append(node)
        else:
            parent.insert(at, node)

    def add_text(self, s: str) -> None:
        if not s:
            return
        if self.foster or not self.stack:
            parent, at = self.place()
        else:
            top = self.stack[-1]
            parent, at = top.content or top, None
        if at is None and parent.kind == "element":
            siblings = parent.children
            if siblings and siblings[-1].kind == "text":
                siblings[-1].data += s
            else:
                parent.append(Node("text", "#text", data=s))
            return
        if parent.kind == "document":
            return
        siblings = parent.children
        before = siblings[(len(siblings) if at is None else at) - 1] if (siblings if at is None else at) else None
        if before is not None and before.kind == "text":
            before.data += s
        else:
            self.put(Node("text", "#text", data=s), (parent, at))

    def add_comment(self, s: str, parent: Node | None = None) -> None:
        self.put(Node("comment", "#comment", data=s), (parent, None) if parent else self.place())

    def add(self, name: str, attrs: dict[str, str], ns: str = "html") -> Node:
        node = Node("element", name, ns, dict(attrs))
        if self.foster:
            self.put(node, self.place())
        else:
            target = self.stack[-1] if self.stack else self.doc
            (target.content or target).append(node)
        self.stack.append(node)
        return node

    def add_void(self, name: str, attrs: dict[str, str]) -> None:
        self.add(name, attrs)
        self.stack.pop()

    def add_missing(self, node: Node, attrs: dict[str, str]) -> None:
        for k, v in attrs.items():
            node.attrs.setdefault(k, v)

    # --- formatting elements ----------------------------------------------------------------------------------------

    def mark(self) -> None:
        self.formatting.append(None)

    def clear_to_mark(self) -> None:
        while self.formatting and self.formatting.pop() is not None:
            pass

    def push_formatting(self, node: Node) -> None:
        same = []
        for i in range(len(self.formatting) - 1, -1, -1):
            other = self.formatting[i]
            if other is None:
                break
            if other.name == node.name and other.ns == node.ns and other.attrs == node.attrs:
                same.append(i)
        if len(same) >= 3:
            del self.formatting[same[-1]]
        self.formatting.append(node)

    def reconstruct(self) -> None:
        f = self.formatting
        if not f or f[-1] is None or f[-1].open:
            return
        i = len(f) - 1
        while i > 0 and f[i - 1] is not None and not f[i - 1].open:
            i -= 1
        for k in range(i, len(f)):
            f[k] = self.add(f[k].name, f[k].attrs)

    def formatting_index(self, name: str) -> int:
        for i in range(len(self.formatting) - 1, -1, -1):
            if self.formatting[i] is None:
                return -1
            if self.formatting[i].name == name:
                return i
        return -1

    def adopt(self, name: str) -> None:
        """The adoption agency."""
        if self.is_current(name) and self.stack[-1].ns == "html" and self.stack[-1] not in self.formatting:
            self.stack.pop()
            return
        for _ in range(8):
            at = self.formatting_index(name)
            if at < 0:
                self.any_other_end(name)
                return
            element = self.formatting[at]
            if not element.open:
                self.error("adoption-agency-1.3")
                del self.formatting[at]
                return
            if not self.node_in_scope(element):
                self.error("adoption-agency-1.3")
                return
            if element is not self.stack[-1]:
                self.error("adoption-agency-1.3")
            where = self.stack.index(element)
            furthest = next((n for n in self.stack[where + 1 :] if n.ns == "html" and n.name in SPECIAL or n.ns == "svg" and n.name in SVG_HTML or n.ns == "math" and (n.name in MATHML_TEXT or n.name == "annotation-xml")), None)
            if furthest is None:
                del self.stack[where:]
                del self.formatting[at]
                return
            ancestor, bookmark = self.stack[where - 1], at
            i = self.stack.index(furthest)
            last, rounds = furthest, 0
            while True:
                i -= 1
                node = self.stack[i]
                if node is element:
                    break
                rounds += 1
                listed = self.formatting.index(node) if node in self.formatting else -1
                if rounds > 3 and listed >= 0:
                    del self.formatting[listed]
                    if listed < bookmark:
                        bookmark -= 1
                    listed = -1
                if listed < 0:
                    del self.stack[i]
                    continue
                new = Node("element", node.name, node.ns, dict(node.attrs))
                self.formatting[listed] = self.stack[i] = new
                if last is furthest:
                    bookmark = listed + 1
                last.detach()
                new.append(last)
                last = new
            last.detach()
            keep, self.foster = self.foster, True
            self.put(last, self.place(ancestor))
            self.foster = keep
            new = Node("element", element.name, element.ns, dict(element.attrs))
            for child in furthest.children:
                new.append(child)
            furthest.children = []
            furthest.append(new)
            at = self.formatting.index(element)
            del self.formatting[at]
            self.formatting.insert(bookmark - (at < bookmark), new)
            self.stack.remove(element)
            self.stack.insert(self.stack.index(furthest) + 1, new)

    def any_other_end(self, name: str) -> None:
        if not self.stack.has(name) and self.stack and self.stack[0].name == "html" and self.stack[0].ns == "html":
            self.error("unexpected-end-tag")  # a search would end at the html element or before it
            return
        for i in range(len(self.stack) - 1, -1, -1):
            node = self.stack[i]
            if node.name == name and node.ns == "html":
                if i != len(self.stack) - 1:
                    self.imply_ends(name)
                    if self.stack and self.stack[-1] is not node:
                        self.error("end-tag-too-early")
                del self.stack[i:]
                return
            if node.ns == "html" and node.name in SPECIAL or node.ns != "html" and (node.name in SVG_HTML or node.name in MATHML_TEXT or node.name == "annotation-xml"):
                self.error("unexpected-end-tag")
                return

    # --- modes ------------------------------------------------------------------------------------------------------

    def reset_mode(self) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            last = i == 0
            node = self.context if last and self.context is not None else self.stack[i]
            name = node.name
            if last and self.doc.kind == "fragment" and (self.context is None or name in ("select", "td", "th", "head")):
                self.mode = "in_body"
                return
            if name == "select":
                self.mode = "in_select"
                for up in reversed(self.stack[:i]):
                    if up.name == "template":
                        break
                    if up.name == "table":
                        self.mode = "in_select_in_table"
                        break
                return
            if name in CELLS and not last:
                self.mode = "in_cell"
            elif name == "tr":
                self.mode = "in_row"
            elif name in SECTIONS:
                self.mode = "in_table_body"
            elif name == "caption":
                self.mode = "in_caption"
            elif name == "colgroup":
                self.mode = "in_column_group"
            elif name == "table":
                self.mode = "in_table"
            elif name == "template":
                self.mode = self.template_modes[-1] if self.template_modes else "in_template"
            elif name == "head" and not last:
                self.mode = "in_head"
            elif name == "body":
                self.mode = "in_body"
            elif name == "frameset":
                self.mode = "in_frameset"
            elif name == "html":
                self.mode = "before_head" if self.head is None else "after_head"
            elif last:
                self.mode = "in_body"
            else:
                continue
            return
        self.mode = "in_body"

    def to_text(self, name: str, attrs: dict[str, str]) -> None:
        self.add(name, attrs)
        self.after_text, self.mode = self.mode, "text"

    # --- tokens ------------------------------------------------------------------------------------------------------

    def adjusted(self) -> Node | None:
        if self.context is not None and len(self.stack) == 1:
            return self.context
        return self.stack[-1] if self.stack else None

    def html_point(self, node: Node) -> bool:
        if node.ns == "svg":
            return node.name in SVG_HTML
        return node.ns == "math" and node.name == "annotation-xml" and ascii_lower(node.attrs.get("encoding", "")) in ("text/html", "application/xhtml+xml")

    def text(self, s: str) -> None:
        if self.skip_newline:
            self.skip_newline = False
            if s.startswith("\n"):
                s = s[1:]
        node = self.adjusted()
        if s and node is not None and node.ns != "html" and node.ns is not None and not self.html_point(node) and not (node.ns == "math" and node.name in MATHML_TEXT):
            if "\0" in s:
                self.error("unexpected-null-character")
                s = s.replace("\0", "\ufffd")
            if s.strip(SPACE):
                self.frameset_ok = False
            self.add_text(s)
            return
        while s:
            s = _TEXT.get(self.mode, TreeBuilder.text_in_body)(self, s)

    def comment(self, s: str) -> None:
        self.flush_table_text()
        self.skip_newline = False
        if self.mode in ("initial", "before_html", "after_after_body", "after_after_frameset"):
            self.add_comment(s, self.doc)
        elif self.mode == "after_body":
            self.add_comment(s, self.stack[0] if self.stack else self.doc)
        else:
            self.add_comment(s)

    def doctype(self, name: str | None, public: str | None, system: str | None, force: bool) -> None:
        self.flush_table_text()
        self.skip_newline = False
        if self.mode != "initial":
            self.error("unexpected-doctype")
            return
        node = Node("doctype", "!doctype")
        node.ids = (name, public, system, force)
        self.doc.append(node)
        p = (public or "").lower()
        if not self.srcdoc:
            if force or name != "html":
                self.quirks = True
            elif public is not None:
                self.quirks = p.startswith(QUIRKS) or p.startswith("-//w3c//dtd html 4.01") and system is None
            elif system is not None:
                self.quirks = True
        self.mode = "before_html"

    def start_tag(self, name: str, attrs: dict[str, str], closing: bool) -> None:
        if self.table_text:
            self.flush_table_text()
        self.skip_newline = False
        self.shows = self.shows or name == "selectedcontent"
        again = True
        while again:
            node = self.adjusted()
            if node is None or node.ns == "html" or node.ns is None or node.ns == "math" and node.name in MATHML_TEXT and name not in ("mglyph", "malignmark") or node.ns == "math" and node.name == "annotation-xml" and name == "svg" or self.html_point(node):
                again = _START[self.mode](self, name, attrs, closing)
            else:
                again = self.start_foreign(name, attrs, closing)

    def end_tag(self, name: str) -> None:
        if self.table_text:
            self.flush_table_text()
        self.skip_newline = False
        node = self.adjusted()
        if node is not None and node.ns != "html" and node.ns is not None and self.end_foreign(name):
            return
        while _END[self.mode](self, name):
            pass

    def eof(self) -> None:
        self.flush_table_text()
        if self.mode == "text":
            self.error("eof-in-script-html-comment-like-text" if self.is_current("script") else "eof-in-tag")
            self.stack.pop()
            self.mode = self.after_text
        if self.mode == "in_head_noscript":
            self.error("eof-in-noscript")
            self.stack.pop()
            self.mode = "in_head"
        while True:
            if self.mode == "initial":
                self.mode = "before_html"
            if self.mode == "before_html":
                self.make_html()
            if self.mode == "before_head":
                self.make_head()
            if self.mode == "in_head":
                self.leave_head()
            if self.mode == "after_head":
                self.make_body()
            if self.mode in ("in_table", "in_table_body", "in_row", "in_cell", "in_caption", "in_column_group"):
                self.error("eof-in-table")
            if not self.template_modes or not any(n.name == "template" and n.ns == "html" for n in self.stack):
                break
            self.error("eof-in-template")
            self.pop_until("template")
            self.clear_to_mark()
            self.template_modes.pop()
            self.reset_mode()
        if self.context is None and self.doc.kind == "document" and self.stack and not any(n.name in ("body", "frameset") for n in self.stack[0].children) and self.mode in ("in_body", "after_body") and self.head is None:
            self.make_body()

    # --- before the body ---------------------------------------------------------------------------------------------

    def make_html(self) -> None:
        self.add("html", {})
        self.mode = "before_head"

    def make_head(self) -> None:
        self.head = self.add("head", {})
        self.mode = "in_head"

    def leave_head(self) -> None:
        self.stack.pop()
        self.mode = "after_head"

    def make_body(self) -> None:
        self.add("body", {})
        self.mode = "in_body"

    def text_initial(self, s: str) -> str:
        rest = s.lstrip(SPACE)
        if rest:
            self.error("expected-doctype-but-got-chars")
            self.quirks = self.quirks or not self.srcdoc
            self.mode = "before_html"
        return rest

    def start_initial(self, name: str, attrs: dict, closing: bool) -> bool:
        self.error("expected-doctype-but-got-start-tag")
        self.quirks, self.mode = self.quirks or not self.srcdoc, "before_html"
        return True

    def end_initial(self, name: str) -> bool:
        self.error("expected-doctype-but-got-end-tag")
        self.quirks, self.mode = self.quirks or not self.srcdoc, "before_html"
        return True

    def text_before_html(self, s: str) -> str:
        rest = s.lstrip(SPACE)
        if rest:
            self.make_html()
        return rest

    def start_before_html(self, name: str, attrs: dict, closing: bool) -> bool:
        if name == "html":
            self.add(name, attrs)
            self.mode = "before_head"
            return False
        self.make_html()
        return True

    def end_before_html(self, name: str) -> bool:
        if name in ("head", "body", "html", "br"):
            self.make_html()
            return True
        self.error("unexpected-end-tag")
        return False

    def text_before_head(self, s: str) -> str:
        rest = s.lstrip(SPACE)
        if rest:
            self.make_head()
        return rest

    def start_before_head(self, name: str, attrs: dict, closing: bool) -> bool:
        if name == "html":
            return self.start_in_body(name, attrs, closing)
        if name == "head":
            self.head = self.add(name, attrs)
            self.mode = "in_head"
            return False
        self.make_head()
        return True

    def end_before_head(self, name: str) -> bool:
        if name in ("head", "body", "html", "br"):
            self.make_head()
            return True
        self.error("unexpected-end-tag")
        return False

    def _leading_space(self, s: str) -> str:
        rest = s.lstrip(SPACE)
        self.add_text(s[: len(s) - len(rest)])
        return rest

    def text_in_head(self, s: str) -> str:
        rest = self._leading_space(s)
        if rest:
            self.leave_head()
        return rest

    def start_in_head(self, name: str, attrs: dict, closing: bool) -> bool:
        if name == "html":
            return self.start_in_body(name, attrs, closing)
        if name in ("base", "basefont", "bgsound", "link", "meta"):
            self.add_void(name, attrs)
        elif name == "title" or name in ("noframes", "style", "script") or name == "noscript" and self.scripting:
            self.to_text(name, attrs)
        elif name == "noscript":
            self.add(name, attrs)
            self.mode = "in_head_noscript"
        elif name == "template":
            self.add(name, attrs)
            self.mark()
            self.frameset_ok = False
            self.mode = "in_template"
            self.template_modes.append("in_template")
        elif name == "head":
            self.error("unexpected-start-tag")
        else:
            self.leave_head()
            return True
        return False

    def end_in_head(self, name: str) -> bool:
        if name == "head":
            self.leave_head()
        elif name in ("body", "html", "br"):
            self.leave_head()
            return True
        elif name == "template":
            self.end_template()
        else:
            self.error("unexpected-end-tag")
        return False

    def end_template(self) -> None:
        if not any(n.name == "template" and n.ns == "html" for n in self.stack):
            self.error("unexpected-end-tag")
            return
        self.imply_ends(names=IMPLIED_END_ALL)
        if not self.is_current("template"):
            self.error("end-tag-too-early")
        while self.stack:
            node = self.stack.pop()
            if node.name == "template" and node.ns == "html":
                break
        self.clear_to_mark()
        if self.template_modes:
            self.template_modes.pop()
        self.reset_mode()

    def text_in_head_noscript(self, s: str) -> str:
        rest = self._leading_space(s)
        if rest:
            self.error("unexpected-char")
            self.stack.pop()
            self.mode = "in_head"
        return rest

    def start_in_head_noscript(self, name: str, attrs: dict, closing: bool) -> bool:
        if name == "html":
            return self.start_in_body(name, attrs, closing)
        if name in ("basefont", "bgsound", "link", "meta", "noframes", "style"):
            return self.start_in_head(name, attrs, closing)
        self.error("unexpected-start-tag")
        if name in ("head", "noscript"):
            return False
        self.stack.pop()
        self.mode = "in_head"
        return True

    def end_in_head_noscript(self, name: str) -> bool:
        if name == "noscript":
            self.stack.pop()
            self.mode = "in_head"
            return False
        self.error("unexpected-end-tag")
        if name == "br":
            self.stack.pop()
            self.mode = "in_head"
            return True
        return False

    def text_after_head(self, s: str) -> str:
        rest = self._leading_space(s)
        if rest:
            self.make_body()
        return rest

    def start_after_head(self, name: str, attrs: dict, closing: bool) -> bool:
        if name == "html":
            return self.start_in_body(name, attrs, closing)
        if name == "body":
            self.add(name, attrs)
            self.frameset_ok = False
            self.mode = "in_body"
        elif name == "frameset":
            self.add(name, attrs)
            self.mode = "in_frameset"
        elif name in HEAD_CONTENT:
            self.error("unexpected-start-tag")
            if self.head is None:
                return self.start_in_head(name, attrs, closing)
            self.stack.append(self.head)
            self.start_in_head(name, attrs, closing)
            if self.head.open:
                self.stack.remove(self.head)
        elif name == "head":
            self.error("unexpected-start-tag")
        else:
            self.make_body()
            return True
        return False

    def end_after_head(self, name: str) -> bool:
        if name in ("body", "html", "br"):
            self.make_body()
            return True
        if name == "template":
            return self.end_in_head(name)
        self.error("unexpected-end-tag")
        return False

    # --- the body ----------------------------------------------------------------------------------------------------

    def text_in_body(self, s: str) -> str:
        if "\0" in s:
            self.error("unexpected-null-character")
            s = s.replace("\0", "")
        if s:
            self.reconstruct()
            self.add_text(s)
            if self.frameset_ok and s.strip(SPACE):
                self.frameset_ok = False
        return ""

    def start_in_body(self, name: str, attrs: dict, closing: bool) -> bool:
        if name in FORMATTING and name not in ("a", "nobr"):
            self.reconstruct()
            self.push_formatting(self.add(name, attrs))
        elif name not in BODY_RULES:
            self.reconstruct()
            self.add(name, attrs)
        elif name == "html":
            self.error("unexpected-start-tag")
            if self.stack and not self.stack.has("template"):
                self.add_missing(self.stack[0], attrs)
        elif name in HEAD_CONTENT or name == "noscript" and self.scripting:
            if name == "noscript":
                self.to_text(name, attrs)
                return False
            return self.start_in_head(name, attrs, closing)
        elif name == "body":
            self.error("unexpected-start-tag")
            if len(self.stack) > 1 and self.stack[1].name == "body" and not self.stack.has("template"):
                self.frameset_ok = False
                self.add_missing(self.stack[1], attrs)
        elif name == "frameset":
            self.error("unexpected-start-tag")
            if self.frameset_ok and len(self.stack) > 1 and self.stack[1].name == "body":
                self.stack[1].detach()
                del self.stack[1:]
                self.add(name, attrs)
                self.mode = "in_frameset"
        elif name in BLOCK_START:
            self.close_p_in_scope()
            self.add(name, attrs)
        elif name in HEADINGS:
            self.close_p_in_scope()
            if self.current is not None and self.current.name in HEADINGS:
                self.error("unexpected-start-tag")
                self.stack.pop()
            self.add(name, attrs)
        elif name in ("pre", "listing"):
            self.close_p_in_scope()
            self.add(name, attrs)
            self.skip_newline, self.frameset_ok = True, False
        elif name == "form":
            templated = self.stack.has("template")
            if self.form is not None and not templated:
                self.error("unexpected-start-tag")
                return False
            self.close_p_in_scope()
            node = self.add(name, attrs)
            if not templated:
                self.form = node
        elif name in ("li", "dd", "dt"):
            self.frameset_ok = False
            family = ("li",) if name == "li" else ("dd", "dt")
            for node in reversed(self.stack) if any(map(self.stack.has, family)) else ():
                if node.name in family:
                    self.imply_ends(node.name)
                    if not self.is_current(node.name):
                        self.error("end-tag-too-early")
                    self.pop_until(node.name)
                    break
                if node.name in SPECIAL and node.ns == "html" and node.name not in ("address", "div", "p"):
                    break
            self.close_p_in_scope()
            self.add(name, attrs)
        elif name == "plaintext":
            self.close_p_in_scope()
            self.add(name, attrs)
            if self.scanner:
                self.scanner.kind = "plaintext"
        elif name == "button":
            if self.in_scope("button"):
                self.error("unexpected-start-tag-implies-end-tag")
                self.imply_ends()
                self.pop_until("button")
            self.reconstruct()
            self.add(name, attrs)
            self.frameset_ok = False
        elif name == "a":
            at = self.formatting_index("a")
            if at >= 0:
                self.error("unexpected-start-tag-implies-end-tag")
                node = self.formatting[at]
                self.adopt("a")
                if node in self.formatting:
                    self.formatting.remove(node)
                if node.open:
                    self.stack.remove(node)
            self.reconstruct()
            self.push_formatting(self.add(name, attrs))
        elif name == "nobr":
            self.reconstruct()
            if self.in_scope("nobr"):
                self.error("unexpected-start-tag-implies-end-tag")
                self.adopt("nobr")
                self.reconstruct()
            self.push_formatting(self.add(name, attrs))
        elif name in ("applet", "marquee", "object"):
            self.reconstruct()
            self.add(name, attrs)
            self.mark()
            self.frameset_ok = False
        elif name == "table":
            if not self.quirks:
                self.close_p_in_scope()
            self.add(name, attrs)
            self.frameset_ok = False
            self.mode = "in_table"
        elif name in ("area", "br", "embed", "img", "keygen", "wbr"):
            self.reconstruct()
            self.add_void(name, attrs)
            self.frameset_ok = False
        elif name == "input":
            self.reconstruct()
            self.add_void(name, attrs)
            if ascii_lower(attrs.get("type", "")) != "hidden":
                self.frameset_ok = False
        elif name in ("param", "source", "track"):
            self.add_void(name, attrs)
        elif name == "hr":
            self.close_p_in_scope()
            self.add_void(name, attrs)
            self.frameset_ok = False
        elif name == "image":
            self.error("unexpected-start-tag")
            return self.start_in_body("img", attrs, closing)
        elif name == "textarea":
            self.to_text(name, attrs)
            self.skip_newline, self.frameset_ok = True, False
        elif name in RAWTEXT:
            if name == "xmp":
                self.close_p_in_scope()
                self.reconstruct()
            if name in ("xmp", "iframe"):
                self.frameset_ok = False
            self.to_text(name, attrs)
        elif name == "select":
            self.reconstruct()
            self.add(name, attrs)
            self.mark()
            self.frameset_ok = False
            self.mode = "in_select_in_table" if self.mode in ("in_table", "in_caption", "in_table_body", "in_row", "in_cell") else "in_select"
        elif name in ("optgroup", "option"):
            if self.is_current("option"):
                self.stack.pop()
            self.reconstruct()
            self.add(name, attrs)
        elif name in ("rb", "rtc", "rp", "rt"):
            if self.in_scope("ruby"):
                self.imply_ends("rtc" if name in ("rp", "rt") else None)
            self.add(name, attrs)
        elif name in ("math", "svg"):
            self.reconstruct()
            self.add_foreign(name, attrs, closing, name)
        elif name in TABLE_PARTS or name in ("frame", "head"):
            self.error("unexpected-start-tag")
        else:  # noscript without scripting
            self.reconstruct()
            self.add(name, attrs)
        return False

    def end_in_body(self, name: str) -> bool:
        if name in ("body", "html"):
            if not self.in_scope("body"):
                self.error("unexpected-end-tag")
                return False
            self.mode = "after_body"
            return name == "html"
        if name == "p":
            if not self.in_scope("p", BUTTON_SCOPE):
                self.error("unexpected-end-tag")
                self.add("p", {})
            self.close_p()
        elif name in FORMATTING:
            self.adopt(name)
        elif name in BLOCK_END:
            if not self.in_scope(name):
                self.error("unexpected-end-tag")
                return False
            self.imply_ends()
            if not self.is_current(name):
                self.error("end-tag-too-early")
            self.pop_until(name)
        elif name == "form":
            if self.stack.has("template"):
                if not self.in_scope("form"):
                    self.error("unexpected-end-tag")
                    return False
                self.imply_ends()
                self.pop_until("form")
                return False
            node, self.form = self.form, None
            if node is None or not self.node_in_scope(node):
                self.error("unexpected-end-tag")
                return False
            self.imply_ends()
            if self.current is not node:
                self.error("end-tag-too-early")
            self.stack.remove(node)
        elif name in ("li", "dd", "dt"):
            if not self.in_scope(name, LIST_SCOPE if name == "li" else SCOPE):
                self.error("unexpected-end-tag")
                return False
            self.imply_ends(name)
            if not self.is_current(name):
                self.error("end-tag-too-early")
            self.pop_until(name)
        elif name in HEADINGS:
            if not self.any_in_scope(HEADINGS):
                self.error("unexpected-end-tag")
                return False
            self.imply_ends()
            if not self.is_current(name):
                self.error("end-tag-too-early")
            self.pop_until(*HEADINGS)
        elif name in ("applet", "marquee", "object"):
            if not self.in_scope(name):
                self.error("unexpected-end-tag")
                return False
            self.imply_ends()
            if not self.is_current(name):
                self.error("end-tag-too-early")
            self.pop_until(name)
            self.clear_to_mark()
        elif name == "br":
            self.error("unexpected-end-tag")
            self.reconstruct()
            self.add_void("br", {})
            self.frameset_ok = False
        elif name == "template":
            self.end_template()
        else:
            self.any_other_end(name)
        return False

    def text_text(self, s: str) -> str:
        self.add_text(s)
        return ""

    def start_text(self, name: str, attrs: dict, closing: bool) -> bool:
        self.mode = self.after_text
        return True

    def end_text(self, name: str) -> bool:
        self.stack.pop()
        self.mode = self.after_text
        return False

    # --- tables ------------------------------------------------------------------------------------------------------

    def text_in_table(self, s: str) -> str:
        if self.current is not None and self.current.name in TABLE_WORDS:
            if "\0" in s:
                self.error("unexpected-null-character")
                s = s.replace("\0", "")
            self.table_text.append(s)
            return ""
        self.foster = True
        self.text_in_body(s)
        self.foster = False
        return ""

    text_in_table_body = text_in_row = text_in_table

    def flush_table_text(self) -> None:
        if not self.table_text:
            return
        s = "".join(self.table_text)
        self.table_text = []
        if s.strip(SPACE):
            self.error("unexpected-char-in-table")
            self.foster = True
            self.text_in_body(s)
            self.foster = False
        else:
            self.add_text(s)

    def start_in_table(self, name: str, attrs: dict, closing: bool) -> bool:
        if name == "caption":
            self.back_to(TABLE_SCOPE)
            self.mark()
            self.add(name, attrs)
            self.mode = "in_caption"
        elif name == "colgroup":
            self.back_to(TABLE_SCOPE)
            self.add(name, attrs)
            self.mode = "in_column_group"
        elif name == "col":
            self.back_to(TABLE_SCOPE)
            self.add("colgroup", {})
            self.mode = "in_column_group"
            return True
        elif name in SECTIONS:
            self.back_to(TABLE_SCOPE)
            self.add(name, attrs)
            self.mode = "in_table_body"
        elif name in CELLS or name == "tr":
            self.back_to(TABLE_SCOPE)
            self.add("tbody", {})
            self.mode = "in_table_body"
            return True
        elif name == "table":
            self.error("unexpected-start-tag-implies-end-tag")
            if not self.in_scope("table", TABLE_SCOPE):
                return False
            self.pop_until("table")
            self.reset_mode()
            return True
        elif name in ("style", "script", "template"):
            return self.start_in_head(name, attrs, closing)
        elif name == "input" and ascii_lower(attrs.get("type", "")) == "hidden":
            self.error("unexpected-hidden-input-in-table")
            self.add_void(name, attrs)
        elif name == "form":
            self.error("unexpected-start-tag-in-table")
            if self.form is None and not self.stack.has("template"):
                self.form = self.add(name, attrs)
                self.stack.pop()
        else:
            self.error("unexpected-start-tag-in-table")
            self.foster = True
            again = self.start_in_body(name, attrs, closing)
            self.foster = False
            return again
        return False

    def end_in_table(self, name: str) -> bool:
        if name == "table":
            if not self.in_scope("table", TABLE_SCOPE):
                self.error("unexpected-end-tag")
                return False
            self.pop_until("table")
            self.reset_mode()
        elif name in TABLE_PARTS or name in ("body", "html"):
            self.error("unexpected-end-tag")
        elif name == "template":
            self.end_template()
        else:
            self.error("unexpected-end-tag")
            self.foster = True
            again = self.end_in_body(name)
            self.foster = False
            return again
        return False

    def text_in_caption(self, s: str) -> str:
        return self.text_in_body(s)

    def _close_caption(self) -> bool:
        if not self.in_scope("caption", TABLE_SCOPE):
            self.error("unexpected-end-tag")
            return False
        self.imply_ends()
        if not self.is_current("caption"):
            self.error("end-tag-too-early")
        self.pop_until("caption")
        self.clear_to_mark()
        self.mode = "in_table"
        return True

    def start_in_caption(self, name: str, attrs: dict, closing: bool) -> bool:
        if name in TABLE_PARTS:
            self.error("unexpected-start-tag-implies-end-tag")
            return self._close_caption()
        return self.start_in_body(name, attrs, closing)

    def end_in_caption(self, name: str) -> bool:
        if name == "caption":
            self._close_caption()
        elif name == "table":
            self.error("unexpected-end-tag")
            return self._close_caption()
        elif name in TABLE_PARTS or name in ("body", "html"):
            self.error("unexpected-end-tag")
        else:
            return self.end_in_body(name)
        return False

    def text_in_column_group(self, s: str) -> str:
        rest = self._leading_space(s)
        if rest:
            if self.is_current("colgroup"):
                self.stack.pop()
                self.mode = "in_table"
                return rest
            self.error("unexpected-char-in-column-group")
        return ""

    def start_in_column_group(self, name: str, attrs: dict, closing: bool) -> bool:
        if name == "html":
            return self.start_in_body(name, attrs, closing)
        if name == "col":
            self.add_void(name, attrs)
        elif name == "template":
            return self.start_in_head(name, attrs, closing)
        elif self.is_current("colgroup"):
            self.stack.pop()
            self.mode = "in_table"
            return True
        else:
            self.error("unexpected-start-tag")
        return False

    def end_in_column_group(self, name: str) -> bool:
        if name == "colgroup":
            if self.is_current("colgroup"):
                self.stack.pop()
                self.mode = "in_table"
            else:
                self.error("unexpected-end-tag")
        elif name == "col":
            self.error("unexpected-end-tag")
        elif name == "template":
            self.end_template()
        elif self.is_current("colgroup"):
            self.stack.pop()
            self.mode = "in_table"
            return True
        else:
            self.error("unexpected-end-tag")
        return False

    BODY_CONTEXT = frozenset(("tbody", "tfoot", "thead", "template", "html"))
    ROW_CONTEXT = frozenset(("tr", "template", "html"))

    def _leave_section(self) -> bool:
        if not self.any_in_scope(SECTIONS, TABLE_SCOPE):
            self.error("unexpected-end-tag")
            return False
        self.back_to(self.BODY_CONTEXT)
        self.stack.pop()
        self.mode = "in_table"
        return True

    def start_in_table_body(self, name: str, attrs: dict, closing: bool) -> bool:
        if name == "tr":
            self.back_to(self.BODY_CONTEXT)
            self.add(name, attrs)
            self.mode = "in_row"
        elif name in CELLS:
            self.error("unexpected-cell-in-table-body")
            self.back_to(self.BODY_CONTEXT)
            self.add("tr", {})
            self.mode = "in_row"
            return True
        elif name in ("caption", "col", "colgroup") or name in SECTIONS:
            return self._leave_section()
        else:
            return self.start_in_table(name, attrs, closing)
        return False

    def end_in_table_body(self, name: str) -> bool:
        if name in SECTIONS:
            if not self.in_scope(name, TABLE_SCOPE):
                self.error("unexpected-end-tag")
                return False
            self.back_to(self.BODY_CONTEXT)
            self.stack.pop()
            self.mode = "in_table"
        elif name == "table":
            return self._leave_section()
        elif name in TABLE_PARTS or name in ("body", "html"):
            self.error("unexpected-end-tag")
        else:
            return self.end_in_table(name)
        return False

    def _leave_row(self) -> bool:
        if not self.in_scope("tr", TABLE_SCOPE):
            self.error("unexpected-end-tag")
            return False
        self.back_to(self.ROW_CONTEXT)
        self.stack.pop()
        self.mode = "in_table_body"
        return True

    def start_in_row(self, name: str, attrs: dict, closing: bool) -> bool:
        if name in CELLS:
            self.back_to(self.ROW_CONTEXT)
            self.add(name, attrs)
            self.mode = "in_cell"
            self.mark()
        elif name in TABLE_PARTS:
            return self._leave_row()
        else:
            return self.start_in_table(name, attrs, closing)
        return False

    def end_in_row(self, name: str) -> bool:
        if name == "tr":
            self._leave_row()
        elif name == "table":
            return self._leave_row()
        elif name in SECTIONS:
            if not self.in_scope(name, TABLE_SCOPE):
                self.error("unexpected-end-tag")
                return False
            return self._leave_row()
        elif name in TABLE_PARTS or name in ("body", "html"):
            self.error("unexpected-end-tag")
        else:
            return self.end_in_table(name)
        return False

    def text_in_cell(self, s: str) -> str:
        return self.text_in_body(s)

    def _close_cell(self, name: str | None = None) -> None:
        self.imply_ends(name)
        if not self.is_current(*([name] if name else CELLS)):
            self.error("end-tag-too-early")
        self.pop_until(*([name] if name else CELLS))
        self.clear_to_mark()
        self.mode = "in_row"

    def start_in_cell(self, name: str, attrs: dict, closing: bool) -> bool:
        if name in TABLE_PARTS:
            if not self.any_in_scope(CELLS, TABLE_SCOPE):
                self.error("unexpected-start-tag")
                return False
            self._close_cell()
            return True
        return self.start_in_body(name, attrs, closing)

    def end_in_cell(self, name: str) -> bool:
        if name in CELLS:
            if not self.in_scope(name, TABLE_SCOPE):
                self.error("unexpected-end-tag")
                return False
            self._close_cell(name)
        elif name in ("body", "caption", "col", "colgroup", "html"):
            self.error("unexpected-end-tag")
        elif name in TABLE_WORDS:
            if not self.in_scope(name, TABLE_SCOPE):
                self.error("unexpected-end-tag")
                return False
            self._close_cell()
            return True
        else:
            return self.end_in_body(name)
        return False

    # --- select ------------------------------------------------------------------------------------------------------

    def text_in_select(self, s: str) -> str:
        for c, code in (("\0", "unexpected-null-character"), ("\f", "invalid-codepoint-in-select")):
            if c in s:
                self.error(code)
                s = s.replace(c, "")
        if s:
            self.reconstruct()
            self.add_text(s)
        return ""

    text_in_select_in_table = text_in_select

    def _leave_select(self) -> None:
        if self.context is not None and self.context.name == "select" and not self.stack.has("select"):
            self.context, self.mode = None, "in_body"
        else:
            self.pop_until("select")
            self.reset_mode()

    def start_in_select(self, name: str, attrs: dict, closing: bool) -> bool:
        if name == "html":
            return self.start_in_body(name, attrs, closing)
        if name in ("option", "optgroup", "hr", "keygen", "plaintext"):
            if self.is_current("option"):
                self.stack.pop()
            if name != "option" and self.is_current("optgroup"):
                self.stack.pop()
            if name == "option":
                self.reconstruct()
            self.add(name, attrs)
            if name in ("hr", "keygen"):
                self.stack.pop()
            elif name == "plaintext" and self.scanner:
                self.scanner.kind = "plaintext"
        elif name == "select":
            self.error("unexpected-start-tag-in-select")
            if self.stack.has("select"):
                self.pop_until("select")
                self.reset_mode()
        elif name in ("input", "textarea"):
            self.error("unexpected-start-tag-in-select")
            if self.select_in_scope():
                self._leave_select()
                return True
        elif name in ("script", "template"):
            return self.start_in_head(name, attrs, closing)
        elif name in ("svg", "math"):
            self.add_foreign(name, attrs, closing, name)
        elif name in FORMATTING:
            self.reconstruct()
            self.push_formatting(self.add(name, attrs))
        elif name in IN_SELECT:
            self.reconstruct()
            self.add(name, attrs)
            if closing:
                self.stack.pop()
        elif name in ("br", "img"):
            self.reconstruct()
            self.add_void(name, attrs)
        elif name in TABLE_PARTS or name == "table":
            self.error("unexpected-start-tag-implies-end-tag")
            self._leave_select()
            return True
        else:
            self.error("unexpected-start-tag-in-select")
        return False

    def end_in_select(self, name: str) -> bool:
        if name == "optgroup":
            if self.is_current("option") and len(self.stack) > 1 and self.stack[-2].name == "optgroup":
                self.stack.pop()
            if self.is_current("optgroup"):
                self.stack.pop()
            else:
                self.error("unexpected-end-tag")
        elif name == "option":
            if self.is_current("option"):
                self.stack.pop()
            else:
                self.error("unexpected-end-tag")
        elif name == "select":
            if not self.select_in_scope():
                self.error("unexpected-end-tag")
                return False
            self.pop_until("select")
            self.clear_to_mark()
            self.reset_mode()
        elif name == "template":
            self.end_template()
        elif name in FORMATTING:
            self.adopt(name)
        elif name in IN_SELECT:
            places = [i for i, n in enumerate(self.stack) if n.name == name]
            select = next((i for i, n in enumerate(self.stack) if n.name == "select"), -1)
            if places and places[-1] > select:
                del self.stack[places[-1] :]
            else:
                self.error("unexpected-end-tag")
        else:
            self.error("unexpected-end-tag")
        return False

    BOUNDARY = frozenset(("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"))

    def start_in_select_in_table(self, name: str, attrs: dict, closing: bool) -> bool:
        if name in self.BOUNDARY:
            self.error("unexpected-start-tag-in-select")
            self._leave_select()
            return True
        return self.start_in_select(name, attrs, closing)

    def end_in_select_in_table(self, name: str) -> bool:
        if name in self.BOUNDARY:
            self.error("unexpected-end-tag-in-select")
            if not self.in_scope(name, TABLE_SCOPE):
                return False
            self._leave_select()
            return True
        return self.end_in_select(name)

    # --- templates, the end and framesets ----------------------------------------------------------------------------

    def start_in_template(self, name: str, attrs: dict, closing: bool) -> bool:
        if name in HEAD_CONTENT:
            return self.start_in_head(name, attrs, closing)
        if name in ("caption", "colgroup") or name in SECTIONS:
            mode = "in_table"
        elif name == "col":
            mode = "in_column_group"
        elif name == "tr":
            mode = "in_table_body"
        elif name in CELLS:
            mode = "in_row"
        else:
            mode = "in_body"
        if self.template_modes:
            self.template_modes[-1] = mode
        self.mode = mode
        return True

    def end_in_template(self, name: str) -> bool:
        if name == "template":
            self.end_template()
        else:
            self.error("unexpected-end-tag-in-template")
        return False

    def text_after_body(self, s: str) -> str:
        rest = s.lstrip(SPACE)
        if len(rest) < len(s):
            self.text_in_body(s[: len(s) - len(rest)])
        if rest:
            self.error("unexpected-char-after-body")
            self.mode = "in_body"
        return rest

    text_after_after_body = text_after_body

    def start_after_body(self, name: str, attrs: dict, closing: bool) -> bool:
        if name == "html":
            return self.start_in_body(name, attrs, closing)
        self.error("unexpected-start-tag-after-body")
        self.mode = "in_body"
        return True

    start_after_after_body = start_after_body

    def end_after_body(self, name: str) -> bool:
        if name == "html":
            if self.context is not None:
                self.error("unexpected-end-tag-after-body")
            else:
                self.mode = "after_after_body"
            return False
        self.error("unexpected-end-tag-after-body")
        self.mode = "in_body"
        return True

    def end_after_after_body(self, name: str) -> bool:
        self.error("unexpected-end-tag-after-body")
        self.mode = "in_body"
        return True

    def _only_space(self, s: str, code: str) -> str:
        kept = "".join(c for c in s if c in SPACE)
        if len(kept) < len(s):
            self.error(code)
        self.add_text(kept)
        return ""

    def text_in_frameset(self, s: str) -> str:
        return self._only_space(s, "unexpected-char-in-frameset")

    def text_after_frameset(self, s: str) -> str:
        return self._only_space(s, "unexpected-char-after-frameset")

    text_after_after_frameset = text_after_frameset

    def start_in_frameset(self, name: str, attrs: dict, closing: bool) -> bool:
        if name == "html":
            return self.start_in_body(name, attrs, closing)
        if name == "frameset":
            self.add(name, attrs)
        elif name == "frame":
            self.add_void(name, attrs)
        elif name == "noframes":
            return self.start_in_head(name, attrs, closing)
        else:
            self.error("unexpected-start-tag-in-frameset")
        return False

    def end_in_frameset(self, name: str) -> bool:
        if name == "frameset" and not (self.is_current("html") and len(self.stack) == 1):
            self.stack.pop()
            if self.context is None and not self.is_current("frameset"):
                self.mode = "after_frameset"
        else:
            self.error("unexpected-end-tag-in-frameset")
        return False

    def start_after_frameset(self, name: str, attrs: dict, closing: bool) -> bool:
        if name == "html":
            return self.start_in_body(name, attrs, closing)
        if name == "noframes":
            return self.start_in_head(name, attrs, closing)
        self.error("unexpected-start-tag-after-frameset")
        return False

    start_after_after_frameset = start_after_frameset

    def end_after_frameset(self, name: str) -> bool:
        if name == "html":
            self.mode = "after_after_frameset"
        else:
            self.error("unexpected-end-tag-after-frameset")
        return False

    def end_after_after_frameset(self, name: str) -> bool:
        self.error("unexpected-end-tag-after-frameset")
        return False

    # --- foreign content ---------------------------------------------------------------------------------------------

    def add_foreign(self, name: str, attrs: dict, closing: bool, ns: str) -> None:
        own = SVG_ATTRIBUTES if ns == "svg" else {"definitionurl": "definitionURL"}
        self.add(SVG_NAMES.get(name, name) if ns == "svg" else name, {own.get(k) or FOREIGN_ATTRIBUTES.get(k, k): v for k, v in attrs.items()}, ns)
        if closing:
            self.stack.pop()

    def start_foreign(self, name: str, attrs: dict, closing: bool) -> bool:
        if name in BREAKOUT or name == "font" and not attrs.keys().isdisjoint(("color", "face", "size")):
            self.error("unexpected-start-tag")
            floor = 1 if self.context is not None else 0
            while len(self.stack) > floor and self.stack[-1].ns not in (None, "html") and not self.html_point(self.stack[-1]) and not (self.stack[-1].ns == "math" and self.stack[-1].name in MATHML_TEXT):
                self.stack.pop()
            node = self.adjusted()
            if node is not None and node is self.context and node.ns not in (None, "html"):
                return getattr(self, "start_" + self.mode)(name, attrs, closing)
            return True
        self.add_foreign(name, attrs, closing, self.adjusted().ns)
        return False

    def end_foreign(self, name: str) -> bool:
        """Whether the end tag was dealt with here; else the mode's own rules hold."""
        if name in ("br", "p"):
            self.error("unexpected-end-tag")
            while len(self.stack) > 1 and self.stack[-1].ns != "html" and not self.html_point(self.stack[-1]) and not (self.stack[-1].ns == "math" and self.stack[-1].name in MATHML_TEXT):
                self.stack.pop()
            return False
        if not self.stack or self.stack[-1].ns == "html":
            return False
        if ascii_lower(self.stack[-1].name) != name:
            self.error("unexpected-end-tag")
        for i in range(len(self.stack) - 1, -1, -1):
            node = self.stack[i]
            if node.ns == "html":
                return False
            if ascii_lower(node.name) == name:
                if i == 0:
                    return True
                del self.stack[i:]
                return True
        return True

    # --- after the parse ---------------------------------------------------------------------------------------------

    def fill_selectedcontent(self) -> None:
        """A selectedcontent element shows what the selected option (else the first) of its select holds."""
        for select in [n for n in (walk(self.doc) if self.shows else ()) if n.kind == "element" and n.name == "select"]:
            below = list(walk(select))
            target = next((n for n in below if n.kind == "element" and n.name == "selectedcontent"), None)
            options = [n for n in below if n.kind == "element" and n.name == "option"]
            if target is not None and options:
                source = next((o for o in options if "selected" in o.attrs), options[0])
                for child in source.children:
                    target.append(child.clone(contents=False))


#: The methods of each insertion mode.
_START, _END, _TEXT = ({name.removeprefix(kind): f for name, f in vars(TreeBuilder).items() if name.startswith(kind) and name != f"{kind}tag"} for kind in ("start_", "end_", "text_"))


class ParseError(NamedTuple):
    """``line`` and ``column`` are those of the scanner; errors of the builder have none."""

    source: str
    code: str
    line: int | None = None
    column: int | None = None

    def __str__(self) -> str:
        return self.code if self.line is None else f"({self.line},{self.column}): {self.code}"


class StrictModeError(ValueError):
    """A strict parse met an error."""

    def __init__(self, error: ParseError):
        super().__init__(str(error))
        self.error = error

    def __reduce__(self) -> tuple:
        return StrictModeError, (self.error,)


def parse(html: str, context: tuple[str, str | None] | None = None, scripting: bool = False, iframe_srcdoc: bool = False, xml_coercion: bool = False, collect_errors: bool = False, strict: bool = False) -> tuple[Node, list[ParseError]]:
    """The tree of a document or fragment, and its errors: the scanner's, then the builder's. ``strict`` raises the first of them."""
    collect_errors = collect_errors or strict
    builder = TreeBuilder(context, scripting, iframe_srcdoc, collect_errors)
    kind, last = "data", ""
    if context and context[1] in (None, "html"):
        last = context[0]
        if last in ("title", "textarea"):
            kind = "rcdata"
        elif last in RAWTEXT or last == "noscript" and scripting:
            kind = "rawtext"
        elif last in ("script", "plaintext"):
            kind = last
        else:
            last = ""
    scanner = Scanner(html, builder, kind, last, scripting, xml_coercion, collect_errors=collect_errors)
    builder.scanner = scanner
    scanner.run()
    builder.fill_selectedcontent()
    errors = [ParseError("tokenizer", *e) for e in scanner.errors()] if collect_errors else []
    errors += [ParseError("tree", code) for code in builder.found]
    if strict and errors:
        raise StrictModeError(errors[0])
    return builder.doc, errors
