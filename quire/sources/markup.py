"""Markup to rows: a tolerant tag scanner and tree, a strict parse, and the fixes both need.

Raw pages are seldom well-formed, so the tolerant way is the main one: a tag is only what matches the
tag pattern in full; all else is text. Both run in Arrow batches, one document at a time, and give flat
tables keyed by (document, node number in preorder).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.entities import html5
from itertools import count
from typing import NamedTuple
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

from quire.functions.text import INLINE_TAGS, VOID_TAGS

NAME, VALUE = r"[A-Za-z0-9_:.\-]", r"[A-Za-z0-9_:.\-,/#?&=%; ]"
ATTRS = rf'(?:[ \n](?:[ \n]|{NAME}+="{VALUE}*")*)?'
TAG = re.compile(rf"<(/?)({NAME}+)({ATTRS})(/?)>")
#: How far a tag that fails had got; the character after it goes to the text too.
PARTIAL = re.compile(rf'<(?:/?(?:{NAME}+(?:[ \n](?:[ \n]|{NAME}+="{VALUE}*")*(?:{NAME}+(?:=(?:"{VALUE}*)?)?)?)?/?)?)?')
ATTR = re.compile(rf'({NAME}+)="({VALUE}*)"')
_WHOLE_NAME, _WHOLE_VALUE = re.compile(rf"[A-Za-z_]{NAME}*"), re.compile(rf"{VALUE}*")
GOOD_NAME = re.compile(r"[A-Za-z_]")


@dataclass(slots=True)
class Node:
    """An element; nodes are told apart by identity, as trees go through edits."""

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    text: str = ""
    tail: str = ""
    children: list[Node] = field(default_factory=list)
    number: int = -1

    def walk(self, path: tuple[Node, ...] = ()) -> Iterator[tuple[tuple[Node, ...], Node]]:
        """Elements in preorder, each with its ancestors."""
        todo = [(path, self)]
        while todo:
            above, node = todo.pop()
            yield above, node
            todo += [((*above, node), c) for c in reversed(node.children)]

    def nodes(self) -> list[Node]:
        """Elements in preorder, without their ancestors."""
        found, todo = [], [self]
        while todo:
            node = todo.pop()
            found.append(node)
            if node.children:
                todo += reversed(node.children)
        return found

    def plain(self) -> str:
        if not self.children:
            return self.text
        out, todo = [], [self]
        parts: list[str | Node] = []
        todo = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            parts = [x.text]
            for c in x.children:
                parts += [c, c.tail]
            todo += reversed(parts)
        return "".join(out)

    def find(self, tag: str) -> Node | None:
        return next((n for _, n in self.walk() if n.tag == tag), None)

    def copy(self) -> Node:
        return Node(self.tag, dict(self.attrs), self.text, self.tail, [c.copy() for c in self.children], self.number)


class Tag(NamedTuple):
    kind: str  # open, close or single
    name: str
    attrs: tuple[tuple[str, str], ...] = ()

    def __str__(self) -> str:
        shown = "".join(f' {k}="{v}"' for k, v in self.attrs)
        return f"<{'/' * (self.kind == 'close')}{self.name}{shown}{'/' * (self.kind == 'single')}>"


def scan(text: str) -> Iterator[str | Tag]:
    """Text and tags in turn."""
    held: list[str] = []
    at = 0
    while (lt := text.find("<", at)) >= 0:
        held.append(text[at:lt])
        m = TAG.match(text, lt)
        tag = _tag(*m.groups()) if m and not (m[1] and m[4]) else None
        if tag:
            if joined := "".join(held):
                yield joined
            held = []
            yield tag
            at = m.end()
        elif m and not (m[1] and m[4]):
            held.append(m[0])  # complete, but not a tag that may stand: text
            at = m.end()
        else:
            end = m.end() - 2 if m else PARTIAL.match(text, lt).end()
            held.append(text[lt : end + 1])
            at = end + 1
    held.append(text[at:])
    if joined := "".join(held):
        yield joined


def _cells(text: str) -> Iterable[str | Tag]:
    """The same as scan(), at once where every "<" begins a tag that may stand."""
    found: list[str | Tag] = []
    at = 0
    for m in TAG.finditer(text):
        closing, name, inside, single = m.groups()
        tag = None if closing and single else _tag(closing, name, inside, single)
        begin, end = m.span()
        if tag is None or "<" in text[at:begin]:
            return scan(text)
        if begin > at:
            found.append(text[at:begin])
        found.append(tag)
        at = end
    if "<" in text[at:]:
        return scan(text)
    if at < len(text):
        found.append(text[at:])
    return found


@lru_cache(4096)
def _tag(closing: str, name: str, inside: str, single: str) -> Tag | None:
    """The tag of a match; the same few come again and again."""
    attrs = tuple(ATTR.findall(inside))
    if closing and attrs or not all(GOOD_NAME.match(n) for n in (name, *(k for k, _ in attrs))):
        return None
    return Tag("close" if closing else "single" if single else "open", name, attrs)


def closed_elements(text: str, tags: tuple[str, ...] = ()) -> Iterator[Node]:
    """Every element at the moment it closes. A closing tag closes what is open inside it; one without an opening is ignored."""
    stack: list[Node] = []
    last: Node | None = None
    for cell in _cells(text):
        if isinstance(cell, str):
            if last is not None:
                last.tail += cell
            elif stack:
                stack[-1].text = cell
        elif cell.kind == "close":
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == cell.name), None)
            if depth is not None:
                last = stack[depth]
                del stack[depth:]
                if not tags or last.tag in tags:
                    yield last
        else:
            node = Node(cell.name, dict(cell.attrs))
            if stack:
                stack[-1].children.append(node)
            if cell.kind == "single":
                last = node
                if not tags or node.tag in tags:
                    yield node
            else:
                stack.append(node)
                last = None


def tree(text: str) -> Node:
    """The whole text under one node ``#root``; elements never closed end where their parent does, void ones at once."""
    root = Node("#root")
    stack, last = [root], None
    for cell in scan(text):
        if isinstance(cell, str):
            if last is not None:
                last.tail += cell
            else:
                stack[-1].text += cell
        elif cell.kind == "close":
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == cell.name), None)
            if depth:
                last = stack[depth]
                del stack[depth:]
        else:
            node = Node(cell.name, dict(cell.attrs))
            stack[-1].children.append(node)
            if cell.kind == "single" or cell.name.lower() in VOID_TAGS:
                last = node
            else:
                stack.append(node)
                last = None
    for i, (_, node) in enumerate(root.walk()):
        node.number = i
    return root


@lru_cache(4096)
def _is_name(name: str) -> bool:
    return bool(_WHOLE_NAME.fullmatch(name))


@lru_cache(4096)
def _shown(kind: str, tag: str, attrs: tuple[tuple[str, str], ...]) -> str:
    """A tag as text; ValueError if it or its attributes can't stand."""
    for name in (tag, *(k for k, _ in attrs)):
        if not _is_name(name):
            raise ValueError(f"not a name: {name}")
    for _, value in attrs:
        if not _WHOLE_VALUE.fullmatch(value):
            raise ValueError(f"not a value: {value}")
    return str(Tag(kind, tag, attrs))


def encode(node: Node, indent: int = 2, depth: int = 0) -> str:
    """Readable markup: one line for short plain elements, else children on lines of their own; attributes sorted."""
    pad = " " * (indent * depth)
    attrs = tuple(sorted(node.attrs.items()))
    if not node.children and not node.text:
        return f"{pad}{_shown('single', node.tag, attrs)}"
    opening, closing = _shown("open", node.tag, attrs), f"</{node.tag}>"
    body = escape_tags(node.text.strip())
    if not node.children and len(body) <= 35 and "\n" not in body:
        return f"{pad}{opening}{body}{closing}"
    inner = " " * (indent * (depth + 1))
    lines = [f"{pad}{opening}"]
    lines += [inner + x for x in body.split("\n")] if body else []
    for c in node.children:
        lines.append(encode(c, indent, depth + 1))
        if tail := escape_tags(c.tail.strip()):
            lines += [inner + x for x in tail.split("\n")]
    return "\n".join([*lines, f"{pad}{closing}"])


def escape_tags(text: str) -> str:
    """Only what reads as a tag is escaped."""
    if "<" not in text:
        return text
    return "".join(str(c).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;") if isinstance(c, Tag) else c for c in scan(text))


# -- bytes and text before a strict parse ----------------------------------------------------------

BOMS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def encoding_of(raw: bytes) -> str:
    """By byte order mark, else the declared one if it decodes, else UTF-8, else Latin-1."""
    for mark, name in BOMS:
        if raw.startswith(mark):
            return name
    declared = re.search(rb"""encoding\s*=\s*["']([^"']+)["']""", raw[:1024], re.I)
    for name in (declared[1].decode("ascii", "replace") if declared else None, "utf-8"):
        if name:
            try:
                raw.decode(name)
                return name
            except (LookupError, UnicodeDecodeError):
                pass
    return "iso-8859-1"


_OPEN_VOID = re.compile(rf"<({'|'.join(VOID_TAGS)})(?![A-Za-z0-9_:.\-])((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>")


def close_voids(text: str) -> str:
    """`<br>` as `<br />`. A closing tag of its own later on ends the element: all before it goes."""
    out, at = [], 0
    while m := _OPEN_VOID.search(text, at):
        out.append(text[at : m.start()])
        attrs = m[2].rstrip()
        if attrs.endswith("/"):
            out.append(m[0])
            at = m.end()
            continue
        out.append(f"<{m[1]}{attrs} />")
        end = text.find(f"</{m[1]}>", m.end())
        at = end + len(m[1]) + 3 if end >= 0 else m.end()
    return "".join([*out, text[at:]])


_ENTITY = re.compile(r"<!--.*?-->|\"[^\"<>]*\"(?=[^<>]*>)|&([A-Za-z][A-Za-z0-9]+);", re.S)


def numeric_entities(text: str) -> str:
    """Named entities as numeric ones; the five of XML, unknown ones and quoted attribute values stay."""

    def numbered(m: re.Match) -> str:
        name = m[1]
        if not name or name in ("amp", "lt", "gt", "apos", "quot") or f"{name};" not in html5:
            return m[0]
        return "".join(f"&#{ord(c)};" for c in html5[f"{name};"])

    return _ENTITY.sub(numbered, text)


#: Prefixes of known namespaces, and those that need none.
PREFIXES = {
    "http://www.w3.org/1999/xhtml": "xhtml", "http://www.idpf.org/2007/ops": "epub", "http://www.w3.org/1998/Math/MathML": "m",
    "http://purl.org/dc/elements/1.1/": "dc", "http://www.daisy.org/z3986/2005/ncx/": "ncx", "http://www.idpf.org/2007/opf": "opf",
    "http://www.w3.org/2000/svg": "svg", "urn:oasis:names:tc:opendocument:xmlns:container": "container", "http://www.w3.org/XML/1998/namespace": "xml",
}


@dataclass
class Document:
    """A strictly parsed document: names are local, namespaces kept per node so that writing is exact."""

    root: Node
    header: str = ""
    encoding: str = "utf-8"
    spaces: dict[int, str] = field(default_factory=dict)  # node number -> namespace of its tag
    attr_spaces: dict[tuple[int, str], str] = field(default_factory=dict)


def parse_strict(raw: bytes | str) -> Document:
    """ValueError if it isn't well-formed even with void elements and entities mended."""
    encoding = encoding_of(raw) if isinstance(raw, bytes) else "utf-8"
    text = raw.decode(encoding).lstrip("﻿") if isinstance(raw, bytes) else raw
    first = re.search(r"<[A-Za-z]", text)
    header, body = (text[: first.start()], text[first.start() :]) if first else (text, "")
    try:
        parsed = ET.fromstring(numeric_entities(close_voids(body)))
    except ET.ParseError as e:
        raise ValueError(f"not well-formed: {e}") from e
    doc = Document(Node(""), header, encoding)
    count = 0

    def local(name: str) -> tuple[str, str]:
        space, _, bare = name.rpartition("}")
        return space[1:], bare

    def build(e: ET.Element) -> Node:
        nonlocal count
        space, tag = local(e.tag)
        node = Node(tag, {}, e.text or "", e.tail or "", [], count)
        count += 1
        if space:
            doc.spaces[node.number] = space
        for k, v in e.attrib.items():
            s, bare = local(k)
            if bare in node.attrs:
                bare = k
            node.attrs[bare] = v
            if s:
                doc.attr_spaces[node.number, bare] = s
        node.children = [build(c) for c in e]
        return node

    doc.root = build(parsed)
    return doc


def _escape(text: str, quote: bool = False) -> str:
    out = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return out.replace('"', "&quot;") if quote else out


def write(doc: Document, html: bool = False) -> bytes:
    """The document with its header, namespaces declared at the root; void elements unclosed for HTML."""
    main = doc.spaces.get(doc.root.number, "")
    others = sorted({*doc.spaces.values(), *doc.attr_spaces.values()} - {main, "http://www.w3.org/XML/1998/namespace"})
    prefix = {s: PREFIXES.get(s, f"ns{i}") for i, s in enumerate(others)} | {"http://www.w3.org/XML/1998/namespace": "xml"}
    declared = (f' xmlns="{_escape(main, True)}"' if main else "") + "".join(f' xmlns:{prefix[s]}="{_escape(s, True)}"' for s in others)

    def show(node: Node, top: bool = False) -> str:
        space = doc.spaces.get(node.number, "")
        name = node.tag if space in ("", main) else f"{prefix[space]}:{node.tag}"
        attrs = "".join(f' {prefix[s] + ":" if (s := doc.attr_spaces.get((node.number, k))) else ""}{k.rpartition("}")[2]}="{_escape(v, True)}"' for k, v in node.attrs.items())
        inner = _escape(node.text) + "".join(show(c) + _escape(c.tail) for c in node.children)
        if not inner and html and node.tag in VOID_TAGS:
            return f"<{name}{attrs}>"
        return f"<{name}{declared * top}{attrs}>{inner}</{name}>" if inner else f"<{name}{declared * top}{attrs} />"

    return (doc.header + show(doc.root, True)).encode(doc.encoding if doc.encoding != "utf-8-sig" else "utf-8", "xmlcharrefreplace")


def renamed(ids: Iterable[str]) -> Iterator[str]:
    """Ids in order, each once: the second of an id becomes id__translated, the n-th id__translated_{n-1}, counted on past names given before."""
    given: set[str] = set()
    times: Counter[str] = Counter()
    for own in ids:
        times[own] = times[own] + 1 if own in given and times[own] else 1 + (own in given)
        names = (own if n == 0 else f"{own}__translated" + f"_{n}" * (n > 1) for n in count(times[own] - 1))
        name = next(n for n in names if n not in given)
        given.add(name)
        yield name


def unique_ids(root: Node) -> None:
    """Each id of a tree once, in document order (see renamed)."""
    owners = [n for _, n in root.walk() if "id" in n.attrs]
    for node, name in zip(owners, renamed([n.attrs["id"] for n in owners]), strict=True):
        node.attrs["id"] = name


# -- segments --------------------------------------------------------------------------------------


_INLINE = frozenset(INLINE_TAGS)


def inline(node: Node) -> bool:
    return _inline(node.tag, node.attrs.get("display", ""))


@lru_cache(4096)
def _inline(tag: str, display: str) -> bool:
    tag, display = tag.lower(), display.lower()
    return tag in _INLINE or display == "inline" or tag == "math" and display != "block"


@dataclass(slots=True)
class Segment:
    text: str
    stack: tuple[Node, ...]
    position: str  # text or tail

    @property
    def block_depth(self) -> int:
        i = len(self.stack)
        while i > 1 and inline(self.stack[i - 1]):
            i -= 1
        return i

    @property
    def block(self) -> Node:
        return self.stack[self.block_depth - 1]


def normal(text: str | None) -> str | None:
    if not text:
        return None
    words = text.split()
    return " " * text[0].isspace() + " ".join(words) + " " * text[-1].isspace() if words else None


def segments(root: Node) -> Iterator[Segment]:
    """Non-blank pieces of text in document order; what follows a child belongs to the parent."""
    todo: list = [((), root)]
    while todo:
        x = todo.pop()
        if isinstance(x, Segment):
            yield x
            continue
        above, node = x
        stack = (*above, node)
        later: list = [Segment(t, stack, "text")] if (t := normal(node.text)) else []
        for c in node.children:
            later.append((stack, c))
            if t := normal(c.tail):
                later.append(Segment(t, stack, "tail"))
        todo += reversed(later)


def content_root(html: str) -> Node:
    """The first body, or all of it; what scripts and styles hold isn't text."""
    root = tree(html)
    body = root.find("body") or root
    for _, node in body.walk():
        if node.tag in ("script", "style"):
            node.text, node.children = "", []
    return body


# -- tables ----------------------------------------------------------------------------------------


#: Most rows in one frame of a table that Python makes, and most that it takes at a time.
FRAME_ROWS, SLICE_ROWS = 4096, 256


def sliced(frames: Iterable[pd.DataFrame], most: int = SLICE_ROWS) -> Iterator[pd.DataFrame]:
    """The frames in slices: what is made of a slice is sent on before the next one is looked at."""
    for f in frames:
        for i in range(0, len(f), most):
            yield f.iloc[i : i + most]


def framed(rows: Iterable[tuple], names: list[str], most: int = FRAME_ROWS) -> Iterator[pd.DataFrame]:
    """Rows as frames of no more than ``most``, however many rows an input row gives."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def _mapped(df: DataFrame, key: str, text: str, rows: Callable[[str], Iterator[tuple]], columns: str) -> DataFrame:
    names = [key] + [c.split(" ")[0] for c in columns.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from framed(((k, *r) for f in frames for k, t in zip(f[key], f[text], strict=True) for r in rows(t or "")), names)

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {columns}")


def elements(df: DataFrame, key: str, text: str, tags: tuple[str, ...] = ()) -> DataFrame:
    """key, close_no, tag, attrs, n_children, n_chars of every element that closes."""
    rows = lambda t: ((i, n.tag, dict(n.attrs), len(n.children), len(n.plain())) for i, n in enumerate(closed_elements(t, tags)))
    return _mapped(df, key, text, rows, "close_no int, tag string, attrs map<string,string>, n_children int, n_chars int")


def nodes(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, node, parent, depth, tag, text, tail: the whole tree in preorder."""
    rows = lambda t: ((n.number, a[-1].number if a else None, len(a), n.tag, n.text, n.tail) for a, n in tree(t).walk())
    return _mapped(df, key, text, rows, "node int, parent int, depth int, tag string, text string, tail string")


def text_segments(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, seg_no, text, stack (node numbers), block_depth, block_node, block_tag, position."""
    rows = lambda t: ((i, s.text, [n.number for n in s.stack], s.block_depth, s.block.number, s.block.tag, s.position) for i, s in enumerate(segments(content_root(t))))
    return _mapped(df, key, text, rows, "seg_no int, text string, stack array<int>, block_depth int, block_node int, block_tag string, position string")


def strict_parse(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, well_formed, n_nodes, error."""

    def rows(t: str) -> Iterator[tuple]:
        try:
            yield True, sum(1 for _ in parse_strict(t).root.walk()), None
        except ValueError as e:
            yield False, None, str(e)

    return _mapped(df, key, text, rows, "well_formed boolean, n_nodes int, error string")
