"""HTML tokens from text. The scanner walks over the text with compiled patterns instead of one state for each character.

A sink has the methods text, start_tag, end_tag, comment, doctype and eof, and the property ``namespace``: the namespace of the
current element ("svg", "math", "html"), or None if it builds no tree.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pagegrain.functions.tables import LEGACY, LONGEST_LEGACY, NAMED, numeric_reference

RCDATA = frozenset(("title", "textarea"))
RAWTEXT = frozenset(("style", "xmp", "iframe", "noembed", "noframes"))
#: Start tags after which the text is of another kind; noscript only with scripting.
SWITCHES = {**dict.fromkeys(RCDATA, "rcdata"), **dict.fromkeys((*RAWTEXT, "noscript"), "rawtext"), "script": "script", "plaintext": "plaintext"}
#: Content kinds; "data" is the ordinary one.
KINDS = ("data", "rcdata", "rawtext", "script", "plaintext", "cdata")

_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_NAME = re.compile(r"[^\t\n\f />]+")
#: Text, then a tag that holds nothing unusual: lower-case names, values without references, no stray marks.
_RUN = re.compile(r"""([^<&\0]*+)(?:<(/?)([a-z][a-z0-9]*+)((?:[\t\n\f ]++[a-z][a-z0-9:_-]*+(?:=(?:"[^"&\0]*+"|'[^'&\0]*+'|[^\t\n\f "'=<>`&\0]++))?+(?=[\t\n\f />]))*+)[\t\n\f ]*+(/?)>)?+""")
_PARTS = re.compile(r"""([a-z][a-z0-9:_-]*+)(?:=(?:"([^"]*+)"|'([^']*+)'|([^\t\n\f ]++)))?+""")
_SPACE = re.compile(r"[\t\n\f ]*")
_ATTRIBUTE = re.compile(r"=?[^\t\n\f />=]*")
_UNQUOTED = re.compile(r"[^\t\n\f >]*")
_REFERENCE = re.compile(r"[A-Za-z0-9]+")
_NUMBER = re.compile(r"[0-9]+")
_HEX = re.compile(r"[0-9A-Fa-f]+")
_SCRIPT = re.compile(r"<!--|-->|<(/?)script(?=[\t\n\f />])", re.I)
_COMMENT_END = re.compile(r"--!?>")
_NOT_XML = re.compile("[\ufdd0-\ufdef" + "".join(chr(p << 16 | x) for p in range(17) for x in (0xFFFE, 0xFFFF)) + "]")


def ascii_lower(s: str) -> str:
    return s.translate(_UPPER)


def charset_newlines(html: str) -> str:
    return html.replace("\r\n", "\n").replace("\r", "\n") if "\r" in html else html


class Scanner:
    """One run over one text."""

    def __init__(self, html: str, sink, kind: str = "data", last_start: str = "", scripting: bool = False, xml_coercion: bool = False, discard_bom: bool = False, collect_errors: bool = False):
        html = charset_newlines(html)
        if discard_bom and html.startswith("\ufeff"):
            html = html[1:]
        self.html, self.sink, self.kind, self.last_start = html, sink, kind, last_start
        self.scripting, self.xml, self.collect = scripting, xml_coercion, collect_errors
        self.at, self.held, self.found = 0, [], []

    def error(self, code: str, at: int | None = None) -> None:
        if self.collect:
            self.found.append((code, self.at if at is None else at))

    def errors(self) -> list[tuple[str, int, int]]:
        """(code, line, column) of what was found, in order."""
        breaks = [m.start() for m in re.finditer("\n", self.html)]
        out = []
        for code, at in self.found:
            line = bisect_right(breaks, at - 1)
            out.append((code, line + 1, at - (breaks[line - 1] + 1 if line else 0) + 1))
        return out

    def hold(self, s: str) -> None:
        if s:
            self.held.append(s)

    def flush(self) -> None:
        if self.held:
            s = "".join(self.held)
            self.held.clear()
            if self.xml:
                s = _NOT_XML.sub("\ufffd", s.replace("\f", " "))
            self.sink.text(s)

    def run(self) -> None:
        n = len(self.html)
        while self.at < n:
            getattr(self, "_" + self.kind)()
        self.flush()
        self.sink.eof()

    # --- content kinds -------------------------------------------------------------------------------------------

    def _data(self) -> None:
        html, n, held = self.html, len(self.html), self.held
        while self.at < n and self.kind == "data":
            m = _RUN.match(html, self.at)
            text, slash, name, parts, closing = m.groups()
            if text:
                held.append(text)
            at = m.end()
            if name is not None:  # most tags
                attrs = {}
                if parts:
                    for key, a, b, c in _PARTS.findall(parts):
                        if key not in attrs:
                            attrs[key] = a or b or c
                self._tag_is(name, attrs, closing == "/", slash == "/", at)
                continue
            self.at = at
            if at >= n:
                break
            c = html[at]
            if c == "<":
                self._markup()
            elif c == "&":
                self.hold(self._reference(False))
            else:
                self.error("unexpected-null-character")
                self.held.append("\0")
                self.at += 1

    def _raw_until_end(self, references: bool) -> None:
        html, start = self.html, self.at
        end = re.compile(rf"</{re.escape(self.last_start)}(?=[\t\n\f />])", re.I) if self.last_start else None
        m = end.search(html, start) if end else None
        stop = m.start() if m else len(html)
        self._hold_raw(start, stop, references)
        self.at = stop
        if m:
            self.kind = "data"
            self._tag(True)

    def _hold_raw(self, start: int, stop: int, references: bool) -> None:
        html = self.html
        self.at = start
        while references and self.at < stop:
            amp = html.find("&", self.at, stop)
            if amp < 0:
                break
            self._hold_plain(self.at, amp)
            self.at = amp
            self.hold(self._reference(False))
        if self.at < stop:
            self._hold_plain(self.at, stop)

    def _hold_plain(self, start: int, stop: int) -> None:
        part = self.html[start:stop]
        if "\0" in part:
            for m in re.finditer("\0", part):
                self.error("unexpected-null-character", start + m.start())
            part = part.replace("\0", "\ufffd")
        self.hold(part)

    def _rcdata(self) -> None:
        self._raw_until_end(True)

    def _rawtext(self) -> None:
        self._raw_until_end(False)

    def _plaintext(self) -> None:
        self._hold_plain(self.at, len(self.html))
        self.at = len(self.html)

    def _script(self) -> None:
        """Until the end tag that isn't hidden: <!-- begins a comment, and a script tag in it begins a part where the end tag ends that part alone."""
        html, start, depth, at = self.html, self.at, 0, self.at
        own = self.last_start or "script"
        end = re.compile(rf"</{re.escape(own)}(?=[\t\n\f />])", re.I)
        pattern = _SCRIPT if own == "script" else re.compile(rf"{_SCRIPT.pattern}|</{re.escape(own)}(?=[\t\n\f />])", re.I)
        while True:
            m = pattern.search(html, at)
            if not m:
                self._hold_plain(start, len(html))
                self.at = len(html)
                if depth:
                    self.error("eof-in-script-html-comment-like-text")
                return
            at = m.end()
            if m[0] == "<!--":
                if not depth:
                    depth = 1
                    at -= 2  # its dashes may be those of the end
            elif m[0] == "-->":
                depth = 0
            elif depth < 2 and end.match(html, m.start()):
                self._hold_plain(start, m.start())
                self.at, self.kind = m.start(), "data"
                self._tag(True)
                return
            elif depth == 1 and not m[1]:
                depth = 2
            elif depth == 2 and m[1]:
                depth = 1

    def _cdata(self) -> None:
        stop = self.html.find("]]>", self.at)
        if stop < 0:
            self.hold(self.html[self.at :])
            self.at = len(self.html)
            self.error("eof-in-cdata")
        else:
            self.hold(self.html[self.at : stop])
            self.at = stop + 3
        self.kind = "data"

    # --- markup ---------------------------------------------------------------------------------------------------

    def _markup(self) -> None:
        html, at = self.html, self.at
        c = html[at + 1 : at + 2]
        if c.isascii() and c.isalpha():
            self._tag(False)
        elif c == "/":
            d = html[at + 2 : at + 3]
            if d.isascii() and d.isalpha():
                self._tag(True)
            elif not d:
                self.error("eof-before-tag-name", at + 2)
                self.hold("</")
                self.at = at + 2
            elif d == ">":
                self.error("missing-end-tag-name", at + 2)
                self.at = at + 3
            else:
                self.error("invalid-first-character-of-tag-name", at + 2)
                self._bogus_comment(at + 2)
        elif c == "!":
            self._declaration(at + 2)
        elif c == "?":
            self.error("unexpected-question-mark-instead-of-tag-name", at + 1)
            self._bogus_comment(at + 1)
        else:
            self.error("invalid-first-character-of-tag-name" if c else "eof-before-tag-name", at + 1)
            self.hold("<")
            self.at = at + 1

    def _bogus_comment(self, start: int) -> None:
        stop = self.html.find(">", start)
        stop = len(self.html) if stop < 0 else stop
        self._comment(self.html[start:stop], start)
        self.at = stop + 1

    def _comment(self, data: str, start: int) -> None:
        if "\0" in data:
            for m in re.finditer("\0", data):
                self.error("unexpected-null-character", start + m.start())
            data = data.replace("\0", "\ufffd")
        self.flush()
        self.sink.comment(data.replace("--", "- -") if self.xml else data)

    def _declaration(self, at: int) -> None:
        html = self.html
        if html.startswith("--", at):
            self._real_comment(at + 2)
        elif html[at : at + 7].lower() == "doctype":
            self._doctype(at + 7)
        elif html.startswith("[CDATA[", at):
            if self.sink.namespace in ("svg", "math"):
                self.at, self.kind = at + 7, "cdata"
            else:
                self.error("cdata-in-html-content", at)
                self._bogus_comment(at)
        else:
            self.error("incorrectly-opened-comment", at)
            self._bogus_comment(at)

    def _real_comment(self, at: int) -> None:
        html = self.html
        for empty in (">", "->"):
            if html.startswith(empty, at):
                self.error("abrupt-closing-of-empty-comment", at)
                self._comment("", at)
                self.at = at + len(empty)
                return
        m = _COMMENT_END.search(html, at)
        if m:
            if m[0] == "--!>":
                self.error("incorrectly-closed-comment", m.start())
            self._comment(html[at : m.start()], at)
            self.at = m.end()
            return
        data = html[at:]
        for tail in ("--!", "--", "-"):
            if data.endswith(tail):
                data = data[: -len(tail)]
                break
        self._comment(data, at)
        self.at = len(html)
        self.error("eof-in-comment")

    def _tag(self, is_end: bool) -> None:
        """A tag from its < to its >; one that the text ends in is dropped."""
        html, n = self.html, len(self.html)
        m = _NAME.match(html, self.at + 1 + is_end)
        name = self._clean(m[0], m.start()).translate(_UPPER)
        at = m.end()
        attrs: dict[str, str] = {}
        closing = False
        while True:
            at = _SPACE.match(html, at).end()
            if at >= n:
                self.at = n
                self.error("eof-in-tag")
                return
            c = html[at]
            if c == ">":
                at += 1
                break
            if c == "/":
                if html.startswith(">", at + 1):
                    closing, at = True, at + 2
                    break
                at += 1
                self.error("eof-in-tag" if at >= n else "unexpected-solidus-in-tag", at)
                if at >= n:
                    self.at = n
                    return
                continue
            m = _ATTRIBUTE.match(html, at)
            if c == "=":
                self.error("unexpected-equals-sign-before-attribute-name", at)
            key = self._clean(m[0], at).translate(_UPPER)
            if self.collect:
                for k, x in enumerate(m[0]):
                    if x in "\"'<":
                        self.error("unexpected-character-in-attribute-name", at + k)
            at = _SPACE.match(html, m.end()).end()
            value = ""
            if at < n and html[at] == "=":
                at = _SPACE.match(html, at + 1).end()
                if at >= n:
                    self.at = n
                    self.error("eof-in-tag")
                    return
                q = html[at]
                if q in "\"'":
                    stop = html.find(q, at + 1)
                    if stop < 0:
                        self._value(at + 1, n)
                        self.at = n
                        self.error("eof-in-tag")
                        return
                    value = self._value(at + 1, stop)
                    at = stop + 1
                    if at < n and html[at] not in "\t\n\f />":
                        self.error("missing-whitespace-between-attributes", at)
                elif q == ">":
                    self.error("missing-attribute-value", at)
                else:
                    stop = _UNQUOTED.match(html, at).end()
                    if self.collect:
                        for k in range(at, stop):
                            if html[k] in "\"'<=`":
                                self.error("unexpected-character-in-unquoted-attribute-value", k)
                    value = self._value(at, stop)
                    at = stop
            if key and key not in attrs:
                attrs[key] = value
        self._tag_is(name, attrs, closing, is_end, at)

    def _tag_is(self, name: str, attrs: dict[str, str], closing: bool, is_end: bool, at: int) -> None:
        self.at = at
        if self.held:
            self.flush()
        if is_end:
            self.sink.end_tag(name)
            return
        self.last_start = name
        self.sink.start_tag(name, attrs, closing)
        kind = SWITCHES.get(name)
        if kind and (name != "noscript" or self.scripting) and self.sink.namespace in (None, "html"):
            self.kind = kind

    def _clean(self, s: str, at: int) -> str:
        if "\0" in s:
            for m in re.finditer("\0", s):
                self.error("unexpected-null-character", at + m.start())
            return s.replace("\0", "\ufffd")
        return s

    def _value(self, start: int, stop: int) -> str:
        """An attribute's value between two places, with its references decoded."""
        html, keep = self.html, self.at
        if html.find("&", start, stop) < 0:
            return self._clean(html[start:stop], start)
        parts, self.at = [], start
        while self.at < stop:
            amp = html.find("&", self.at, stop)
            if amp < 0:
                break
            parts.append(self._clean(html[self.at : amp], self.at))
            self.at = amp
            parts.append(self._reference(True, stop))
        if self.at < stop:
            parts.append(self._clean(html[self.at : stop], self.at))
        self.at = keep
        return "".join(parts)

    # --- character references -------------------------------------------------------------------------------------

    def _reference(self, in_attribute: bool, stop: int | None = None) -> str:
        """The text for the & at hand; moves behind what it stands for. ``stop``: end of the attribute's value."""
        html, at = self.html, self.at + 1
        if html.startswith("#", at):
            return self._numeric(at + 1)
        m = _REFERENCE.match(html, at) if stop is None else _REFERENCE.match(html, at, stop)
        if not m:
            self.at = at
            return "&"
        name, end = m[0], m.end()
        closed = html.startswith(";", end) and (stop is None or end < stop)
        if closed and name in NAMED:
            self.at = end + 1
            return NAMED[name]
        best = next((k for k in range(len(name), 0, -1) if name[:k] in NAMED), 0)
        known = name[:best] if name[:best] in LEGACY else ""
        if best and not (in_attribute and closed):
            if in_attribute:
                after = name[best : best + 1] or html[end : end + 1]
                if after == "=" or after.isascii() and after.isalnum():
                    self.at = end
                    return "&" + name
            if not known and not closed:
                known = next((name[:k] for k in range(min(best - 1, LONGEST_LEGACY), 0, -1) if name[:k] in LEGACY), "")
            if known:
                self.at = at + len(known)
                if not closed:
                    self.error("missing-semicolon-after-character-reference")
                return NAMED[known]
        self.at = end
        if closed:
            self.error("unknown-named-character-reference")
        return "&" + name

    def _numeric(self, at: int) -> str:
        html = self.html
        hexadecimal = html[at : at + 1] in ("x", "X") and html[at : at + 1] != ""
        m = (_HEX if hexadecimal else _NUMBER).match(html, at + hexadecimal)
        if not m:
            start = self.at
            self.at = at + hexadecimal
            self.error("absence-of-digits-in-numeric-character-reference")
            return html[start : self.at]
        self.at = m.end()
        if html.startswith(";", self.at):
            self.at += 1
        else:
            self.error("missing-semicolon-after-character-reference")
        digits = m[0].lstrip("0")
        code = int(digits or "0", 16 if hexadecimal else 10) if len(digits) < 9 else 0x110000
        if code == 0:
            self.error("null-character-reference")
        elif code > 0x10FFFF:
            self.error("character-reference-outside-unicode-range")
        elif 0xD800 <= code <= 0xDFFF:
            self.error("surrogate-character-reference")
        elif 0xFDD0 <= code <= 0xFDEF or code & 0xFFFE == 0xFFFE:
            self.error("noncharacter-character-reference")
        elif code == 0x0D or code < 0x20 and code not in (9, 10, 12) or 0x7F <= code <= 0x9F:
            self.error("control-character-reference")
        return numeric_reference(code)

    # --- doctype --------------------------------------------------------------------------------------------------

    def _doctype(self, at: int) -> None:
        html, n = self.html, len(self.html)
        stop = html.find(">", at)

        def emit(name: str | None, public: str | None, system: str | None, quirks: bool, end: int) -> None:
            self.at = end
            self.flush()
            self.sink.doctype(name, public, system, quirks)

        if at < n and html[at] not in "\t\n\f >":
            self.error("missing-whitespace-before-doctype-name", at)
        at = _SPACE.match(html, at).end()
        if at >= n:
            self.error("eof-in-doctype", n)
            return emit(None, None, None, True, n)
        if html[at] == ">":
            self.error("missing-doctype-name", at)
            return emit(None, None, None, True, at + 1)
        m = re.compile(r"[^\t\n\f >]+").match(html, at)
        name = self._clean(m[0], at).translate(_UPPER)
        at = _SPACE.match(html, m.end()).end()
        if at >= n:
            self.error("eof-in-doctype", n)
            return emit(name, None, None, True, n)
        if html[at] == ">":
            return emit(name, None, None, False, at + 1)
        word = html[at : at + 6].lower()
        if word not in ("public", "system"):
            self.error("invalid-character-sequence-after-doctype-name", at)
            return emit(name, None, None, True, n if stop < 0 else html.find(">", at) + 1 or n)
        ids: dict[str, str | None] = {"public": None, "system": None}
        at += 6
        which = word
        first = True
        while True:
            spaced = _SPACE.match(html, at).end()
            if spaced >= n:
                self.error("eof-in-doctype", n)
                return emit(name, ids["public"], ids["system"], True, n)
            c = html[spaced]
            if c == ">":
                if first:
                    self.error(f"missing-doctype-{which}-identifier", spaced)
                return emit(name, ids["public"], ids["system"], first, spaced + 1)
            if c not in "\"'":
                if ids["system"] is not None:
                    self.error("unexpected-character-after-doctype-system-identifier", spaced)
                    quirks = False
                else:
                    self.error(f"missing-quote-before-doctype-{which}-identifier", spaced)
                    quirks = True
                end = html.find(">", spaced)
                return emit(name, ids["public"], ids["system"], quirks, n if end < 0 else end + 1)
            if ids["system"] is not None:
                self.error("unexpected-character-after-doctype-system-identifier", spaced)
                end = html.find(">", spaced)
                return emit(name, ids["public"], ids["system"], False, n if end < 0 else end + 1)
            if spaced == at:
                self.error(f"missing-whitespace-after-doctype-{which}-keyword" if first else "missing-whitespace-between-doctype-public-and-system-identifiers", at)
            end = html.find(c, spaced + 1)
            sharp = html.find(">", spaced + 1)
            if end < 0 or 0 <= sharp < end:
                if sharp < 0:
                    self.error("eof-in-doctype", n)
                    ids[which] = self._clean(html[spaced + 1 :], spaced + 1)
                    return emit(name, ids["public"], ids["system"], True, n)
                self.error(f"abrupt-doctype-{which}-identifier", sharp)
                ids[which] = self._clean(html[spaced + 1 : sharp], spaced + 1)
                return emit(name, ids["public"], ids["system"], True, sharp + 1)
            ids[which] = self._clean(html[spaced + 1 : end], spaced + 1)
            at, first, which = end + 1, False, "system"


class TokenList:
    """A sink that keeps tokens as (kind, name, attrs, self_closing, data, public_id, system_id, force_quirks)."""

    namespace = None

    def __init__(self) -> None:
        self.tokens: list[tuple] = []

    def text(self, s: str) -> None:
        self.tokens.append(("character", None, None, None, s, None, None, None))

    def start_tag(self, name: str, attrs: dict[str, str], closing: bool) -> None:
        self.tokens.append(("start", name, attrs, closing, None, None, None, None))

    def end_tag(self, name: str) -> None:
        self.tokens.append(("end", name, None, None, None, None, None, None))

    def comment(self, s: str) -> None:
        self.tokens.append(("comment", None, None, None, s, None, None, None))

    def doctype(self, name: str | None, public: str | None, system: str | None, quirks: bool) -> None:
        self.tokens.append(("doctype", name, None, None, None, public, system, quirks))

    def eof(self) -> None:
        self.tokens.append(("eof", None, None, None, None, None, None, None))


def tokenize(html: str, **options) -> tuple[list[tuple], list[tuple[str, int, int]]]:
    sink = TokenList()
    scanner = Scanner(html, sink, **options)
    scanner.run()
    return sink.tokens, scanner.errors()
