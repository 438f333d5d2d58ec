"""The encoding of an HTML file: label, byte order mark, declaration in the bytes, and decoding."""

from __future__ import annotations

import re

#: Fixed labels that are known; all others count as none.
LABELS = {
    **dict.fromkeys(("utf-8", "utf8"), "utf-8"),
    **dict.fromkeys(("utf-7", "utf7", "x-utf-7"), "windows-1252"),
    **dict.fromkeys(("iso-8859-1", "iso8859-1", "latin1", "latin-1", "l1", "cp819", "ibm819"), "windows-1252"),
    **dict.fromkeys(("windows-1252", "windows1252", "cp1252", "x-cp1252"), "windows-1252"),
    **dict.fromkeys(("iso-8859-2", "iso8859-2", "latin2", "latin-2"), "iso-8859-2"),
    **dict.fromkeys(("euc-jp", "eucjp"), "euc-jp"),
    **dict.fromkeys(("utf-16", "utf16"), "utf-16"),
    **dict.fromkeys(("utf-16le", "utf16le"), "utf-16le"),
    **dict.fromkeys(("utf-16be", "utf16be"), "utf-16be"),
}
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))
#: Bytes outside comments, and bytes in all, that are searched for a declaration.
SEARCHED, SEARCHED_ALL = 1024, 65536

_CHARSET = re.compile(rb"charset[\t\n\f\r ]*=[\t\n\f\r ]*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\t\n\f\r ;][^\t\n\f\r ;]*)|(?=;))", re.I)
_ATTRIBUTE_NAME = re.compile(rb"[^\t\n\f\r =>/<]*")
_UNQUOTED = re.compile(rb"[^\t\n\f\r ><]*")
_GAP = re.compile(rb"[\t\n\f\r ]*")


def normalize_label(label: str | None) -> str | None:
    return LABELS.get(label.strip().lower()) if label else None


def declared(label: bytes) -> str | None:
    """A label that the bytes themselves declare: UTF-16 can't be true there."""
    try:
        name = normalize_label(label.decode("ascii"))
    except UnicodeDecodeError:
        return None
    return "utf-8" if name and name.startswith("utf-16") else name


def byte_order_mark(data: bytes) -> tuple[str | None, int]:
    return next(((name, len(mark)) for mark, name in MARKS if data.startswith(mark)), (None, 0))


def charset_of_content(content: bytes) -> bytes | None:
    at = content.lower().find(b"charset")
    m = _CHARSET.match(content, at) if at >= 0 else None
    return next((g for g in m.groups() if g is not None), b"").lower() if m else None


def _tag_end(data: bytes, at: int, spent: int) -> tuple[int, int]:
    """Behind the > of a tag, minding quotes, or where the search ends."""
    quote = 0
    while at < min(len(data), SEARCHED_ALL) and spent < SEARCHED:
        c = data[at]
        at, spent = at + 1, spent + 1
        if quote:
            quote = 0 if c == quote else quote
        elif c in b"\"'":
            quote = c
        elif c == 0x3E:
            break
    return at, spent


def _meta(data: bytes, at: int) -> tuple[dict[bytes, bytes | None], int] | None:
    """The attributes of a meta tag and the place behind it; None if it isn't closed."""
    found: dict[bytes, bytes | None] = {}
    while at < min(len(data), SEARCHED_ALL):
        c = data[at : at + 1]
        if c == b">":
            return found, at + 1
        if c == b"<":
            return None
        if c in b"\t\n\f\r /":
            at += 1
            continue
        m = _ATTRIBUTE_NAME.match(data, at)
        at = _GAP.match(data, m.end()).end()
        value = None
        if data[at : at + 1] == b"=":
            at = _GAP.match(data, at + 1).end()
            q = data[at : at + 1]
            if not q:
                return None
            if q in b"\"'":
                end = data.find(q, at + 1)
                if end < 0:
                    return None
                value, at = data[at + 1 : end], end + 1
            else:
                v = _UNQUOTED.match(data, at)
                value, at = v[0], v.end()
        if not m[0] and value is None:
            at += 1
        found[m[0].lower()] = value
    return None


def declaration(data: bytes) -> str | None:
    at = spent = 0
    while at < min(len(data), SEARCHED_ALL) and spent < SEARCHED:
        if data[at] != 0x3C:
            at, spent = at + 1, spent + 1
            continue
        if data.startswith(b"<!--", at):
            end = data.find(b"-->", at + 4)
            if end < 0:
                return None
            at = end + 3
            continue
        m = re.compile(rb"<(/|[A-Za-z]+)").match(data, at)
        if not m:
            at, spent = at + 1, spent + 1
        elif m[1].lower() != b"meta":
            at, spent = _tag_end(data, at, spent)
        else:
            got = _meta(data, m.end())
            if got is None:
                at, spent = at + 1, spent + 1
                continue
            attrs, end = got
            name = declared(attrs.get(b"charset") or b"")
            if not name and (attrs.get(b"http-equiv") or b"").lower() == b"content-type" and attrs.get(b"content") is not None:
                name = declared(charset_of_content(attrs[b"content"]) or b"")
            if name:
                return name
            spent += end - at
            at = end
    return None


def sniff(data: bytes, transport: str | None = None) -> tuple[str, int]:
    """(encoding, length of the byte order mark): by transport label, mark, declaration, else windows-1252."""
    name = normalize_label(transport)
    if name:
        return name, 0
    name, n = byte_order_mark(data)
    return (name, n) if name else (declaration(data) or "windows-1252", 0)


_WINDOWS = {b: (chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252")) for b in range(256)}
_WINDOWS_TABLE = "".join(_WINDOWS[b] for b in range(256))


def decode_html(data: bytes, transport: str | None = None) -> tuple[str, str, bool]:
    """(text, encoding, failed). Bytes that the encoding can't hold make the whole text empty."""
    name, skip = sniff(data, transport)
    data, codec = data[skip:], name
    if name == "utf-16":
        inner, n = byte_order_mark(data)
        codec = inner if inner in ("utf-16le", "utf-16be") else "utf-16le"
        data = data[n:] if codec == inner else data
    if codec == "windows-1252":
        return data.decode("latin-1").translate(dict(enumerate(_WINDOWS_TABLE))), name, False
    try:
        return data.decode({"utf-16le": "utf-16-le", "utf-16be": "utf-16-be"}.get(codec, codec)), name, False
    except UnicodeDecodeError:
        return "", name, True
