"""CSS selectors: a parser, and two ways to evaluate them: over the nodes relation, and inside one parsed document."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class SelectorError(ValueError):
    def __init__(self, message: str, position: int):
        super().__init__(f"{message} at {position}")
        self.message, self.position = message, position


@dataclass(frozen=True)
class Simple:
    kind: str  # any, type, id, class, attr, pseudo, nth, not, never
    name: str = ""
    op: str = ""
    value: str = ""
    fold: bool = False
    a: int = 0
    b: int = 0
    inner: tuple = ()


@dataclass(frozen=True)
class Complex:
    """Compounds from left to right; ``links[i]`` joins compound i and i + 1."""

    compounds: tuple[tuple[Simple, ...], ...]
    links: tuple[str, ...] = ()


PLAIN_PSEUDO = frozenset(("first-child", "last-child", "only-child", "first-of-type", "last-of-type", "only-of-type", "empty", "root"))
NTH_PSEUDO = frozenset(("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"))
SPACE = " \t\n\r\f"


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def space(self) -> bool:
        start = self.at
        while self.peek() and self.peek() in SPACE:
            self.at += 1
        return self.at > start

    def expect(self, c: str) -> None:
        if self.peek() != c:
            raise SelectorError(f"expected {c!r}", self.at)
        self.at += 1

    def name(self, what: str) -> str:
        start = self.at
        while (c := self.peek()) and (c.isalnum() or c in "-_"):
            self.at += 1
        if self.at == start:
            raise SelectorError(f"expected {what}", start)
        return self.text[start : self.at]

    def group(self) -> tuple[Complex, ...]:
        self.space()
        out = [self.complex()]
        while True:
            self.space()
            if self.peek() != ",":
                return tuple(out)
            self.at += 1
            self.space()
            out.append(self.complex())

    def complex(self) -> Complex:
        compounds, links = [self.compound()], []
        while True:
            spaced = self.space()
            c = self.peek()
            if c and c in ">+~":
                self.at += 1
                self.space()
            elif spaced and c and c not in ",)":
                c = " "
            else:
                return Complex(tuple(compounds), tuple(links))
            links.append(c)
            compounds.append(self.compound())

    def compound(self) -> tuple[Simple, ...]:
        out: list[Simple] = []
        while (c := self.peek()) and (c in "*#.[:" or c.isalnum() or c in "-_"):
            if c in "*" or c.isalnum() or c in "-_":
                if out:
                    break
                if c == "*":
                    self.at += 1
                    out.append(Simple("any"))
                else:
                    out.append(Simple("type", self.name("a name").lower()))
            elif c == "[":
                out.append(self.attribute())
            elif c == ":":
                out.append(self.pseudo())
            else:
                self.at += 1
                out.append(Simple("id" if c == "#" else "class", self.name("a name")))
        if not out:
            raise SelectorError("expected a selector", self.at)
        return tuple(out)

    def attribute(self) -> Simple:
        self.expect("[")
        self.space()
        name = self.name("an attribute name")
        self.space()
        op = ""
        if self.peek() != "]":
            if self.peek() and self.peek() in "~|^$*":
                op = self.peek()
                self.at += 1
            self.expect("=")
            op += "="
            self.space()
            value = self.string()
            self.space()
            fold = self.peek() in ("i", "I") and self.peek() != ""
            if fold or self.peek() in ("s", "S") and self.peek() != "":
                self.at += 1
                self.space()
            self.expect("]")
            return Simple("attr", name, op, value, fold)
        self.expect("]")
        return Simple("attr", name)

    def string(self) -> str:
        q = self.peek()
        if q not in ("'", '"'):
            start = self.at
            while (c := self.peek()) and c not in SPACE and c != "]":
                self.at += 1
            return self.text[start : self.at]
        self.at += 1
        out = []
        while True:
            c = self.peek()
            if not c:
                raise SelectorError("the string isn't closed", self.at)
            self.at += 1
            if c == q:
                return "".join(out)
            if c == "\\" and self.peek():
                c = self.peek()
                self.at += 1
            out.append(c)

    def pseudo(self) -> Simple:
        self.expect(":")
        if self.peek() == ":":
            self.at += 1
            self.name("a pseudo-element")
            return Simple("never")
        start = self.at
        name = self.name("a pseudo-class").lower()
        if name in PLAIN_PSEUDO:
            return Simple("pseudo", name)
        if name == "not":
            self.expect("(")
            self.space()
            inner = self.compound()
            self.space()
            self.expect(")")
            return Simple("not", inner=inner)
        if name in NTH_PSEUDO:
            self.expect("(")
            self.space()
            a, b = self.nth()
            self.space()
            self.expect(")")
            return Simple("nth", name, a=a, b=b)
        raise SelectorError(f"unknown pseudo-class {name!r}", start)

    def number(self) -> int | None:
        start = self.at
        while self.peek() and self.peek() in "0123456789":
            self.at += 1
        return int(self.text[start : self.at]) if self.at > start else None

    def nth(self) -> tuple[int, int]:
        for word, value in (("odd", (2, 1)), ("even", (2, 0))):
            if self.text[self.at : self.at + len(word)].lower() == word:
                self.at += len(word)
                return value
        sign = -1 if self.peek() == "-" else 1
        if self.peek() in ("+", "-") and self.peek():
            self.at += 1
        n = self.number()
        if self.peek().lower() != "n" or not self.peek():
            if n is None:
                raise SelectorError("expected a number", self.at)
            return 0, sign * n
        self.at += 1
        a = sign * (1 if n is None else n)
        self.space()
        if self.peek() and self.peek() in "+-":
            sign = -1 if self.peek() == "-" else 1
            self.at += 1
            self.space()
            return a, sign * (self.number() or 0)
        return a, 0


def parse_selector(text: str) -> tuple[Complex, ...]:
    """The selector's alternatives. What follows a whole selector without a space before it is ignored."""
    return _Parser(text).group()


# --- over the nodes relation ------------------------------------------------------------------------------------------


def _value(name: str) -> Column:
    low = name.lower()
    return F.coalesce(F.col("attrs")[name], F.col("attrs")[low]) if low != name else F.col("attrs")[name]


def _pieces(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def _nth(a: int, b: int, place: Column) -> Column:
    if a == 0:
        return place == b
    return ((place - b) % a == 0) & ((place >= b) if a > 0 else (place <= b))


def simple_column(s: Simple, elements_only: bool = False) -> Column:
    """A condition that is never null."""
    if s.kind == "any":
        c = F.col("kind") == "element" if elements_only else F.col("kind").isin("element", "doctype")
    elif s.kind == "type":
        c = F.lower("name") == s.name
    elif s.kind == "id":
        c = F.col("attrs")["id"] == s.name
    elif s.kind == "class":
        c = F.array_contains(_pieces(F.col("attrs")["class"]), s.name)
    elif s.kind == "attr":
        v, w = _value(s.name), s.value
        if s.fold:
            v, w = F.lower(v), w.lower()
        c = {
            "": v.isNotNull(),
            "=": v == w,
            "~=": F.array_contains(_pieces(v), w),
            "|=": (v == w) | v.startswith(w + "-"),
            "^=": v.startswith(w),
            "$=": v.endswith(w),
            "*=": v.contains(w),
        }[s.op]
    elif s.kind == "nth":
        kind = "type" if s.name.endswith("of-type") else "elem"
        place = F.col(f"{kind}_idx")
        c = _nth(s.a, s.b, F.col(f"{kind}_cnt") - place + 1 if "last" in s.name else place)
    elif s.kind == "not":
        c = ~compound_column(s.inner, elements_only)
    elif s.kind == "never":
        c = F.lit(False)
    else:
        c = {
            "first-child": F.col("elem_idx") == 1,
            "last-child": F.col("elem_idx") == F.col("elem_cnt"),
            "only-child": F.col("parent_elem_cnt") == 1,
            "first-of-type": F.col("type_idx") == 1,
            "last-of-type": F.col("type_idx") == F.col("type_cnt"),
            "only-of-type": F.col("type_cnt") == 1,
            "empty": F.col("is_empty"),
            "root": F.col("parent_name").isin("#document", "#document-fragment"),
        }[s.name]
    c = F.coalesce(c, F.lit(False))
    return c & (F.col("kind") == "element") if elements_only else c


def compound_column(compound: tuple[Simple, ...], elements_only: bool = False) -> Column:
    out = simple_column(compound[0], elements_only)
    for s in compound[1:]:
        out = out & simple_column(s, elements_only)
    return out


#: The columns of the nodes relation that selectors look at.
SELECTOR_COLUMNS = ("node_id", "last_pre", "parent_id", "tree_id", "sib_idx", "kind", "name", "attrs", "elem_idx", "elem_cnt", "type_idx", "type_cnt", "prev_elem_id", "parent_elem_cnt", "is_empty", "parent_name")


def selector_condition(selector: str, elements_only: bool = False) -> Column:
    """A selector without combinators as a condition on the nodes relation, never null."""
    group = parse_selector(selector)
    if any(g.links for g in group):
        raise ValueError("a selector with combinators isn't a condition on single nodes; use select")
    return functools.reduce(lambda x, y: x | y, (compound_column(g.compounds[0], elements_only) for g in group))


def select(nodes: DataFrame, selector: str, elements_only: bool = False) -> DataFrame:
    """The nodes that match, each once. ``nodes`` needs doc_id and the columns of the nodes relation.

    Selectors without combinators are one filter. A descendant is one window over each document, any other combinator one left
    semi join on equal keys, with the left part reduced to those; doc_id is among all keys, so nodes that are partitioned by doc_id once aren't shuffled again
    (with spark.sql.requireAllClusterKeysForCoPartition=false).
    """
    group = parse_selector(selector)
    if not any(g.links for g in group):
        return nodes.filter(selector_condition(selector, elements_only))
    parts = [_chain(nodes, g, elements_only) for g in group]
    if len(parts) == 1:
        return parts[0]
    keys = parts[0].select("doc_id", "node_id")
    for p in parts[1:]:
        keys = keys.union(p.select("doc_id", "node_id"))
    return nodes.join(keys.distinct(), ["doc_id", "node_id"], "left_semi")


def _chain(nodes: DataFrame, g: Complex, elements_only: bool) -> DataFrame:
    """Descendants are one sorted pass over each document's rows: intervals nest, so a node has a matching ancestor if the largest end
    of the matches before it in its tree is not before it. Later siblings compare with their parent's first match."""
    found = nodes.filter(compound_column(g.compounds[0], elements_only))
    held = compound_column(g.compounds[0], elements_only)  # while it is a condition on the nodes themselves
    for link, compound in zip(g.links, g.compounds[1:], strict=True):
        here = compound_column(compound, elements_only)
        if link == " ":
            both = nodes.withColumn("_left", held) if held is not None else nodes.join(found.select("doc_id", "node_id").withColumn("_left", F.lit(True)), ["doc_id", "node_id"], "left").withColumn("_left", F.coalesce("_left", F.lit(False)))
            before = Window.partitionBy("doc_id", "tree_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
            both = both.withColumn("_here", here).filter("_left or _here").withColumn("_end", F.max(F.when(F.col("_left"), F.col("last_pre"))).over(before))
            found = both.filter((F.col("_end") >= F.col("node_id")) & F.col("_here")).select(nodes.columns)
        else:
            right = nodes.filter(here)
            same = right["doc_id"] == F.col("l_doc_id")
            if link == "~":
                left = found.filter("kind = 'element'").groupBy(F.col("doc_id").alias("l_doc_id"), F.col("parent_id").alias("l_parent_id")).agg(F.min("sib_idx").alias("l_sib_idx"))
                on = same & (right["parent_id"] == F.col("l_parent_id")) & (right["sib_idx"] > F.col("l_sib_idx"))
            else:
                left = found.select(F.col("doc_id").alias("l_doc_id"), F.col("node_id").alias("l_node_id"))
                on = same & (right["parent_id" if link == ">" else "prev_elem_id"] == F.col("l_node_id"))
            found = right.join(left, on, "left_semi")
        held = None
    return found


# --- inside one document ----------------------------------------------------------------------------------------------


def needs_positions(group: tuple[Complex, ...]) -> bool:
    """Whether a match looks at positions among siblings."""

    def local(s: Simple) -> bool:
        return s.kind == "nth" or s.kind == "pseudo" and s.name not in ("empty", "root") or any(map(local, s.inner))

    return any("+" in g.links or any(local(s) for c in g.compounds for s in c) for g in group)


def _attribute_test(s: Simple) -> Callable[[dict], bool]:
    name, low, w, op = s.name, s.name.lower(), s.value.lower() if s.fold else s.value, s.op

    def value(r: dict) -> str | None:
        v = r["attrs"].get(name)
        return r["attrs"].get(low) if v is None else v

    compare = {
        "": lambda v: True,
        "=": lambda v: v == w,
        "~=": lambda v: bool(w) and w in v.split(" "),
        "|=": lambda v: v == w or v.startswith(w + "-"),
        "^=": lambda v: v.startswith(w),
        "$=": lambda v: v.endswith(w),
        "*=": lambda v: w in v,
    }[op]

    def test(r: dict) -> bool:
        v = value(r)
        return v is not None and compare(v.lower() if s.fold else v)

    return test


_PSEUDO_TESTS: dict[str, Callable[[dict], bool]] = {
    "first-child": lambda r: r["elem_idx"] == 1,
    "last-child": lambda r: r["elem_idx"] is not None and r["elem_idx"] == r["elem_cnt"],
    "only-child": lambda r: r["parent_elem_cnt"] == 1,
    "first-of-type": lambda r: r["type_idx"] == 1,
    "last-of-type": lambda r: r["type_idx"] is not None and r["type_idx"] == r["type_cnt"],
    "only-of-type": lambda r: r["type_cnt"] == 1,
    "empty": lambda r: r["is_empty"],
    "root": lambda r: r["parent_name"] in ("#document", "#document-fragment"),
}


def _simple_test(s: Simple) -> Callable[[dict], bool]:
    """The condition on a row of the nodes relation, as a function."""
    if s.kind == "any":
        return lambda r: r["kind"] in ("element", "doctype")
    if s.kind == "type":
        return lambda r: r["name"] == s.name or r["name"].lower() == s.name
    if s.kind == "id":
        return lambda r: r["attrs"].get("id") == s.name
    if s.kind == "class":
        return lambda r: s.name in r["attrs"].get("class", "").split(" ")
    if s.kind == "attr":
        return _attribute_test(s)
    if s.kind == "not":
        inner = _compound_test(s.inner)
        return lambda r: not inner(r)
    if s.kind == "never":
        return lambda r: False
    if s.kind == "pseudo":
        return _PSEUDO_TESTS[s.name]
    kind, last = "type" if s.name.endswith("of-type") else "elem", "last" in s.name

    def nth(r: dict) -> bool:
        i = r[f"{kind}_idx"]
        if i is None:
            return False
        i = r[f"{kind}_cnt"] - i + 1 if last else i
        return i == s.b if s.a == 0 else (i - s.b) % s.a == 0 and (i >= s.b if s.a > 0 else i <= s.b)

    return nth


def _compound_test(compound: tuple[Simple, ...]) -> Callable[[dict], bool]:
    tests = [_simple_test(s) for s in compound]
    if len(tests) == 1:
        return tests[0]
    return lambda r: all(t(r) for t in tests)


@functools.lru_cache(maxsize=256)
def _tests(group: tuple[Complex, ...]) -> list[list[Callable[[dict], bool]]]:
    return [[_compound_test(c) for c in g.compounds] for g in group]


def match_rows(rows: list[dict], group: tuple[Complex, ...]) -> list[int]:
    """The node ids that match, in traversal order: one pass over the rows for each compound."""
    found: set[int] = set()
    for g, tests in zip(group, _tests(group), strict=True):
        held = {r["node_id"] for r in rows if tests[0](r)}
        for link, test in zip(g.links, tests[1:], strict=True):
            if not held:
                break
            here = [r for r in rows if test(r)]
            if link == ">":
                held = {r["node_id"] for r in here if r["parent_id"] in held}
            elif link == "+":
                held = {r["node_id"] for r in here if r["prev_elem_id"] in held}
            elif link == "~":
                first: dict[int, int] = {}
                for i in sorted(held):
                    if rows[i]["kind"] == "element" and rows[i]["parent_id"] is not None:
                        first.setdefault(rows[i]["parent_id"], rows[i]["sib_idx"])
                held = {r["node_id"] for r in here if r["parent_id"] in first and first[r["parent_id"]] < r["sib_idx"]}
            else:
                below: list[bool] = []  # whether an ancestor in the same tree is held
                for r in rows:
                    p = r["parent_id"]
                    below.append(p is not None and (p in held or below[p]))
                held = {r["node_id"] for r in here if below[r["node_id"]]}
        found |= held
    return sorted(found)
