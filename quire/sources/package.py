"""EPUB archives: members, package, spine, contents and metadata as tables, and archives written back."""

from __future__ import annotations

import io
import os
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.sources.markup import Document, Node, parse_strict, write

#: Metadata that is never translated, media types of chapters and of contents.
SKIPPED = ("language", "identifier", "date", "meta", "contributor")
CHAPTER_TYPES = ("application/xhtml+xml", "text/html")
NCX_TYPE = "application/x-dtbncx+xml"
#: As many names of package files as a filter lists; of more none is made.
NAMES = 64
MEMBERS = "book_id string, entry_no int, path string, compress_type int, content binary"


# -- tables ----------------------------------------------------------------------------------------


def members(spark: SparkSession, paths: str) -> DataFrame:
    """One row for each file of the archives: book_id, entry_no, path, compress_type, content."""
    return unzipped(spark.read.format("binaryFile").load(paths).select(F.col("path").alias("book_id"), "content"))


def names(archives: DataFrame, prefix: str = "") -> DataFrame:
    """book_id, entry_no, path, compress_type of the members whose path begins with prefix, by the directories of archives (book_id, content): nothing is inflated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for book, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(raw.as_buffer())) as z:
                    rows += [(book, i, e.filename, e.compress_type) for i, e in enumerate(z.infolist()) if not e.is_dir() and e.filename.startswith(prefix)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int32()), strict=True)], ["book_id", "entry_no", "path", "compress_type"])

    return archives.select("book_id", "content").mapInArrow(run, "book_id string, entry_no int, path string, compress_type int")


def unzipped(archives: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for book, raw in zip(f["book_id"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    rows = [(book, i, e.filename, e.compress_type, z.read(e)) for i, e in enumerate(z.infolist()) if not e.is_dir()]
                yield pd.DataFrame(rows, columns=["book_id", "entry_no", "path", "compress_type", "content"])

    return archives.mapInPandas(run, MEMBERS)


def with_replaced(all_members: DataFrame, replaced: DataFrame) -> DataFrame:
    """Members with the new content of those replaced (book_id, path, content), the rest as they were; each member once.

    replaced is used once, so it may come from a stage that isn't repeatable; of several rows of a member one is taken.
    """
    new = replaced.groupBy("book_id", "path").agg(F.first("content", ignorenulls=True).alias("_new"))
    joined = all_members.join(new, ["book_id", "path"], "left").withColumn("content", F.coalesce("_new", "content"))
    return joined.select(*all_members.columns)


def zipped(all_members: DataFrame) -> DataFrame:
    """book_id, content of whole archives, ``mimetype`` first, each member compressed as before; a task holds one archive at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda book, out: pa.RecordBatch.from_arrays([pa.array([book], pa.string()), pa.array([out.getvalue()], pa.binary())], ["book_id", "content"])
        open_book, out, z = None, None, None
        for batch in batches:
            books, paths, kinds = (batch.column(i).to_pylist() for i in range(3))
            for book, path, kind, content in zip(books, paths, kinds, batch.column(3), strict=True):
                if z is None or book != open_book:
                    if z is not None:
                        z.close()
                        yield row(open_book, out)
                    open_book, out = book, io.BytesIO()
                    z = zipfile.ZipFile(out, "w")
                z.writestr(zipfile.ZipInfo(path), content.as_buffer() if content.is_valid else b"", compress_type=kind)
        if z is not None:
            z.close()
            yield row(open_book, out)

    rows = all_members.select("book_id", "path", "compress_type", "content", "entry_no").repartition("book_id")
    rows = rows.sortWithinPartitions("book_id", F.col("path") != "mimetype", "entry_no").drop("entry_no")
    return rows.mapInArrow(run, "book_id string, content binary")


def saved(archives: DataFrame, folder: str) -> DataFrame:
    """book_id, target: archives (book_id, content) as files of a folder that all executors have mounted.

    A file appears under its name only once it is whole: it is written beside it and renamed.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            targets = []
            for book, raw in zip(f["book_id"], f["content"], strict=True):
                target = os.path.join(folder, posixpath.basename(book.rstrip("/")).removesuffix(".epub") + ".epub")
                part = f"{target}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as out:
                    out.write(raw)
                os.replace(part, target)
                targets.append(target)
            yield pd.DataFrame({"book_id": f["book_id"], "target": targets})

    return archives.mapInPandas(run, "book_id string, target string")


def listed(all_members: DataFrame, prefix: str) -> DataFrame:
    """Members whose path begins with prefix, in the order of their archive."""
    return all_members.where(F.startswith(F.col("path"), F.lit(prefix)))


def opf_path(container: bytes) -> str:
    """Where the package file is; ValueError if the container doesn't say."""
    node = parse_strict(container).root.find("rootfile")
    if node is None or not node.attrs.get("full-path"):
        raise ValueError("container without a rootfile")
    return node.attrs["full-path"]


def packages(all_members: DataFrame) -> DataFrame:
    """book_id, opf_path, version, manifest, spine and metadata of each book, or an error.

    The container names the package file, whatever its name; only these two members of a book are read.
    """
    schema = "book_id string, opf_path string, version int, manifest array<struct<id:string,href:string,media_type:string,properties:string>>, spine array<string>, metadata array<struct<tag_name:string,text:string>>, error string"

    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for book, raw in zip(f["book_id"], f["content"], strict=True):
                try:
                    rows.append((book, opf_path(raw), None))
                except ValueError as e:
                    rows.append((book, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["book_id", "path", "error"])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                error = r.error if r.error is not None else None if r.content is not None else f"KeyError: {r.path!r}"
                try:
                    rows.append((r.book_id, r.path, *read_package(r.content), None) if error is None else (r.book_id, None, None, [], [], [], error))
                except ValueError as e:
                    rows.append((r.book_id, None, None, [], [], [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["book_id", "opf_path", "version", "manifest", "spine", "metadata", "error"])

    content = all_members.select("book_id", "path", "content")
    containers = content.where(F.col("path") == "META-INF/container.xml").select("book_id", "content").mapInPandas(named, "book_id string, path string, error string")
    books = content.select("book_id").distinct().join(containers, "book_id", "left").withColumn("error", F.when(F.col("path").isNull(), F.coalesce("error", F.lit("KeyError: 'META-INF/container.xml'"))))
    # Package files have few different names, by which most members are left out before their content is read or made.
    names = [r.path for r in containers.where("path is not null").select("path").distinct().limit(NAMES + 1).collect()]
    found = (content.where(F.col("path").isin(names)) if len(names) <= NAMES else content).join(books.select("book_id", "path"), ["book_id", "path"])
    return books.join(found, ["book_id", "path"], "left").select("book_id", "path", "error", "content").mapInPandas(read, schema)


def read_package(opf: bytes) -> tuple[int, list[dict], list[str], list[dict]]:
    root = parse_strict(opf).root
    manifest, spine_, meta = root.find("manifest"), root.find("spine"), _metadata_node(root)
    items = [{"id": c.attrs.get("id"), "href": c.attrs.get("href"), "media_type": c.attrs.get("media-type"), "properties": c.attrs.get("properties")} for c in (manifest.children if manifest else []) if c.tag == "item"]
    refs = [c.attrs.get("idref", "") for c in (spine_.children if spine_ else []) if c.tag == "itemref"]
    fields = [{"tag_name": c.tag, "text": c.plain()} for c in (meta.children if meta else [])]
    return (3 if root.attrs.get("version", "2.0").startswith("3") else 2), items, refs, fields


def _metadata_node(root: Node) -> Node | None:
    return next((n for _, n in root.walk() if n.tag.endswith("metadata")), None)


def spine(manifest: DataFrame, refs: DataFrame, keys: list[str], opf_dir: Column, media_types: tuple[str, ...] = CHAPTER_TYPES) -> DataFrame:
    """refs (keys, idref, ...) with the path of the chapter, of the last manifest item (by pos) of that id; others are left out."""
    items = manifest.groupBy(*keys, "id").agg(F.max_by(F.struct("href", "media_type"), "pos").alias("item"))
    rows = refs.where(F.coalesce(F.col("idref"), F.lit("")) != "").join(items.withColumnRenamed("id", "idref"), [*keys, "idref"])
    return rows.where(F.col("item.media_type").isin(*media_types)).withColumns({"path": F.concat_ws("/", F.nullif(opf_dir, F.lit("")), F.col("item.href")), "media_type": F.col("item.media_type")}).drop("item")


def chapters(package_rows: DataFrame) -> DataFrame:
    """book_id, spine_pos, path of every chapter in reading order."""
    return spined(package_rows).select("book_id", "spine_pos", "path")


def spined(package_rows: DataFrame) -> DataFrame:
    """book_id, spine_pos, path, media_type of the chapters that the spine refers to."""
    directory = F.regexp_extract("opf_path", "^(.*)/[^/]*$", 1)
    m = package_rows.select("book_id", F.posexplode("manifest").alias("pos", "i")).select("book_id", "pos", "i.id", "i.href", "i.media_type")
    r = package_rows.select("book_id", directory.alias("dir"), F.posexplode("spine").alias("spine_pos", "idref"))
    return spine(m, r, ["book_id"], F.col("dir")).select("book_id", "spine_pos", "path", "media_type")


def toc_path(package_rows: DataFrame) -> DataFrame:
    """book_id, version, path: the first NCX item, or from version 3 the first with the property nav."""
    m = package_rows.select("book_id", "version", F.regexp_extract("opf_path", "^(.*)/[^/]*$", 1).alias("dir"), F.posexplode("manifest").alias("pos", "i"))
    nav = F.array_contains(F.split(F.coalesce("i.properties", F.lit("")), " "), "nav")
    fits = F.when(F.col("version") == 3, nav).otherwise(F.col("i.media_type") == NCX_TYPE)
    return m.where(fits).groupBy("book_id", "version", "dir").agg(F.min_by("i.href", "pos").alias("href")).select("book_id", "version", F.concat_ws("/", F.nullif("dir", F.lit("")), "href").alias("path"))


def translatable(fields: DataFrame) -> DataFrame:
    """Metadata fields with text, trimmed, but those that are never translated."""
    return fields.withColumn("text", F.trim("text")).where(~F.col("tag_name").isin(*SKIPPED) & (F.col("text") != ""))


def updated_fields(old: DataFrame, new: DataFrame) -> DataFrame:
    """The k-th field of a tag takes the text of the k-th new one of that tag; what is over stays."""
    k = F.row_number().over(Window.partitionBy("book_id", "tag_name").orderBy("field_no"))
    n = new.withColumn("k", k).select("book_id", "tag_name", "k", F.col("text").alias("new_text"))
    return old.withColumn("k", k).join(n, ["book_id", "tag_name", "k"], "left").withColumn("text", F.coalesce("new_text", "text")).drop("k", "new_text")


def write_metadata(opf: bytes, fields: list[tuple[str, str]]) -> bytes:
    """The package file with the texts of (tag, text) in the non-blank elements of those tags, in order."""
    doc = parse_strict(opf)
    meta = _metadata_node(doc.root)
    waiting: dict[str, list[str]] = {}
    for tag, text in fields:
        waiting.setdefault(tag, []).append(text)
    for c in meta.children if meta else []:
        if c.plain().strip() and waiting.get(c.tag):
            c.text, c.children = waiting[c.tag].pop(0), []
    return write(doc)


# -- contents --------------------------------------------------------------------------------------


@dataclass
class Toc:
    title: str
    href: str | None = None
    fragment: str | None = None
    id: str | None = None
    children: list[Toc] = field(default_factory=list)

    @property
    def full_href(self) -> str | None:
        return f"{self.href or ''}#{self.fragment}" if self.fragment else self.href

    def walk(self) -> Iterator[Toc]:
        yield self
        for c in self.children:
            yield from c.walk()


def split_href(href: str | None) -> tuple[str | None, str | None]:
    path, _, fragment = (href or "").partition("#")
    return path or None, fragment or None


def _child(node: Node | None, tag: str) -> Node | None:
    return next((c for c in node.children if c.tag == tag), None) if node else None


def read_toc(raw: bytes, version: int) -> list[Toc]:
    root = parse_strict(raw).root
    return _ncx(root.find("navMap")) if version == 2 else _nav(_nav_list(root))


def _ncx(parent: Node | None) -> list[Toc]:
    found = []
    for point in parent.children if parent else []:
        title = (label.plain() if (label := _child(_child(point, "navLabel"), "text")) else "").strip()
        if point.tag == "navPoint" and title:
            content = _child(point, "content")
            found.append(Toc(title, *split_href(content.attrs.get("src") if content else None), point.attrs.get("id"), _ncx(point)))
    return found


def _nav_list(root: Node) -> Node | None:
    nav = next((n for _, n in root.walk() if n.tag == "nav" and n.attrs.get("type") == "toc"), None)
    return nav.find("ol") if nav else None


def _nav(ol: Node | None) -> list[Toc]:
    found = []
    for li in ol.children if ol else []:
        a = _child(li, "a") or _child(li, "span")
        if li.tag == "li" and a is not None and (title := a.plain().strip()):
            found.append(Toc(title, *split_href(a.attrs.get("href")), li.attrs.get("id") or a.attrs.get("id"), _nav(_child(li, "ol"))))
    return found


def match_toc(old: list[Toc], new: list[Toc]) -> list[int | None]:
    """For each new entry the old one it goes on: by id, then by full href, then by position; each old one once."""
    found: list[int | None] = [None] * len(new)
    free = dict.fromkeys(range(len(old)))
    for key in (lambda t: t.id, lambda t: t.full_href):
        for i, t in enumerate(new):
            if found[i] is None and key(t) is not None:
                found[i] = next((j for j in free if key(old[j]) == key(t)), None)
                if found[i] is not None:
                    del free[found[i]]
    for i in range(len(new)):
        if found[i] is None and free:
            found[i] = next(iter(free))
            del free[found[i]]
    return found


def write_toc(raw: bytes, version: int, entries: list[Toc]) -> bytes:
    """The contents file with these entries: matched elements are kept and reordered, the rest made anew, play order renumbered."""
    doc = parse_strict(raw)
    number = [max((n.number for _, n in doc.root.walk()), default=0)]
    space = doc.spaces.get(doc.root.number)

    def new(tag: str, **attrs: str) -> Node:
        number[0] += 1
        if space:
            doc.spaces[number[0]] = space
        return Node(tag, attrs, number=number[0])

    read, item = (_ncx, "navPoint") if version == 2 else (_nav, "li")

    def fill(parent: Node, tocs: list[Toc]) -> None:
        current = [c for c in parent.children if c.tag == item]
        shown = [read(Node("", children=[c])) for c in current]
        current = [c for c, s in zip(current, shown, strict=True) if s]
        matched = match_toc([s[0] for s in shown if s], tocs)
        others = [c for c in parent.children if c.tag != item]
        parent.children = others
        for t, j in zip(tocs, matched, strict=True):
            node = current[j] if j is not None else new(item, **({"id": t.id} if t.id else {}))
            parent.children.append(node)
            (fill_point if version == 2 else fill_li)(node, t)

    def own(node: Node, tag: str, at: int) -> Node:
        found = _child(node, tag)
        if found is None:
            found = new(tag)
            node.children.insert(at, found)
        return found

    def fill_point(node: Node, t: Toc) -> None:
        text = own(own(node, "navLabel", 0), "text", 0)
        text.text, text.children = t.title, []
        if t.full_href:
            own(node, "content", 1).attrs["src"] = t.full_href
        fill(node, t.children)

    def fill_li(node: Node, t: Toc) -> None:
        label = _child(node, "a") or _child(node, "span") or own(node, "a" if t.full_href else "span", 0)
        label.tag = "a" if t.full_href else "span"
        label.attrs.pop("href", None)
        if t.full_href:
            label.attrs["href"] = t.full_href
        label.text, label.children = t.title, []
        if t.children or _child(node, "ol"):
            fill(own(node, "ol", 1), t.children)

    top = doc.root.find("navMap") if version == 2 else _nav_list(doc.root)
    if top is None:
        raise ValueError("contents without a list")
    fill(top, entries)
    for i, node in enumerate(n for _, n in top.walk() if n.tag == "navPoint"):
        node.attrs["playOrder"] = str(i + 1)
    return write(doc)


def renumbered(contents: DataFrame) -> DataFrame:
    """contents (book_id, version, content) read and written again: entries kept, play order from 1 on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raws = [write_toc(bytes(raw), int(v), read_toc(bytes(raw), int(v))) for raw, v in zip(f["content"], f["version"], strict=True)]
            yield f[["book_id", "version"]].assign(content=raws)

    return contents.select("book_id", "version", "content").mapInPandas(run, "book_id string, version int, content binary")


def flat_toc(entries: list[Toc]) -> list[tuple]:
    """(node_no, parent_no, depth, title, href, fragment, id) in preorder."""
    rows: list[tuple] = []

    def add(ts: list[Toc], parent: int | None, depth: int) -> None:
        for t in ts:
            rows.append((len(rows), parent, depth, t.title, t.href, t.fragment, t.id))
            add(t.children, rows[-1][0], depth + 1)

    add(entries, None, 0)
    return rows


def encode_toc(entries: list[Toc]) -> Node:
    """Contents as an element, for the same path that chapters take."""

    def item(t: Toc) -> Node:
        attrs = {k: v for k, v in (("href", t.href), ("fragment", t.fragment), ("id", t.id)) if v is not None}
        return Node("toc-item", attrs, children=[Node("title", text=t.title), *map(item, t.children)])

    return Node("toc-list", children=[item(t) for t in entries])


def decode_toc(root: Node) -> list[Toc]:
    if root.tag != "toc-list":
        raise ValueError(f"not a list of contents: {root.tag}")

    def item(n: Node) -> Toc:
        title = _child(n, "title")
        if title is None or not title.plain():
            raise ValueError("an entry without a title")
        return Toc(title.plain(), n.attrs.get("href"), n.attrs.get("fragment"), n.attrs.get("id"), [item(c) for c in n.children if c.tag == "toc-item"])

    return [item(c) for c in root.children]


def encode_metadata(fields: list[tuple[str, str]]) -> Node:
    return Node("metadata-list", children=[Node("field", {"tag": tag}, text) for tag, text in fields])


def decode_metadata(root: Node) -> list[tuple[str, str]]:
    if root.tag != "metadata-list":
        raise ValueError(f"not a list of metadata: {root.tag}")
    if any(not c.attrs.get("tag") or not c.plain() for c in root.children):
        raise ValueError("a field without a tag or text")
    return [(c.attrs["tag"], c.plain()) for c in root.children]


def directory(path: str) -> str:
    return posixpath.dirname(path)


def body_of(doc: Document) -> Node | None:
    """The first body; chapters without one are passed over."""
    return doc.root.find("body")
