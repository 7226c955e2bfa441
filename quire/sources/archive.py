"""Archives as a data source: members of EPUB files read by prefix, and written as a set that appears or doesn't.

    archive.register(spark)
    spark.read.format("archives").option("prefix", "OPS/").load("/books")       # book_id, entry_no, path, compress_type, content
    archive.written(members, "/shared/translated")

The source opens files itself, so the folder has to be mounted on the driver and on all executors; archives in
stores that only Spark reads go through ``package.members``.
"""

from __future__ import annotations

import glob
import os
import posixpath
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quire.sources.package import MEMBERS

#: Compressed bytes that a task reads; a larger archive is shared out by its entries.
PARTITION_BYTES = 16 << 20


def local(path: str) -> str:
    """A path as open() takes it; ValueError for one of another file system."""
    scheme, _, rest = path.partition(":")
    if "/" not in scheme and rest:
        if scheme != "file":
            raise ValueError(f"{path}: archives are read and written in mounted folders")
        return "/" + rest.lstrip("/")
    return path


@dataclass
class Part(InputPartition):
    """Archives with the entries to read, from one number to another; None reads to the end."""

    files: list[tuple[str, int, int | None]]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.prefix, self.suffix = local(options["path"]), options.get("prefix", ""), options.get("suffix", "")
        self.size = int(options.get("partitionbytes", PARTITION_BYTES))

    def wanted(self, path: str) -> bool:
        """Whether a member is read: tested by name, before it is inflated."""
        return path.startswith(self.prefix) and path.endswith(self.suffix)

    def partitions(self) -> list[Part]:
        """Small archives are put together by size, unopened; of a large one the central directory says where its members part."""
        names = sorted(glob.glob(os.path.join(self.path, "**", "*.epub"), recursive=True) if os.path.isdir(self.path) else glob.glob(self.path))
        parts: list[Part] = []
        open_part, room = Part([]), 0
        for name in names:
            size = os.path.getsize(name)
            if size > self.size:
                parts += self._shared_out(name)
                continue
            if size > room and open_part.files:
                parts.append(open_part)
                open_part = Part([])
            room = self.size - size if not open_part.files else room - size
            open_part.files.append((name, 0, None))
        return parts + [open_part] * bool(open_part.files) or [Part([])]

    def _shared_out(self, name: str) -> list[Part]:
        with zipfile.ZipFile(name) as z:
            found, first, total, last = [], 0, 0, 0
            for i, e in enumerate(z.infolist()):
                size = e.compress_size if self.wanted(e.filename) else 0
                if total and total + size > self.size:
                    found.append(Part([(name, first, i)]))
                    first, total = i, 0
                total, last = total + size, i + 1
        return [*found, Part([(name, first, last)])]

    def read(self, partition: Part) -> Iterator[tuple]:
        for name, first, last in partition.files:
            with zipfile.ZipFile(name) as z:
                for i, e in list(enumerate(z.infolist()))[first:last]:
                    if not e.is_dir() and self.wanted(e.filename):
                        yield name, i, e.filename, e.compress_type, z.read(e)


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]


class ArchiveWriter(DataSourceWriter):
    """Each task writes whole archives into a hidden folder; they get their names when all tasks have ended well.

    What repeated tasks leave there, or a writer that was given up, is never seen. Rows of an archive have
    to come to one task in the order of the archive (``written`` sees to that).
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.folder = local(options["path"])
        self.staging = os.path.join(self.folder, f".staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Staged:
        own = os.path.join(self.staging, uuid.uuid4().hex)
        os.makedirs(own)
        done, book, out = [], None, None
        seen: set[str] = set()
        try:
            for r in iterator:
                if r.book_id != book:
                    if out:
                        out.close()
                    if r.book_id in seen:
                        raise ValueError(f"{r.book_id}: the members of an archive have to stand together")
                    book = r.book_id
                    seen.add(book)
                    name = posixpath.basename(book.rstrip("/")).removesuffix(".epub") + ".epub"
                    part = os.path.join(own, f"{len(done)}.part")
                    done.append((part, os.path.join(self.folder, name)))
                    out = zipfile.ZipFile(part, "w")
                out.writestr(zipfile.ZipInfo(r.path), bytes(r.content), compress_type=r.compress_type)
        finally:
            if out:
                out.close()
        return Staged(done)

    def commit(self, messages: list[Staged | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        if len({target for _, target in files}) < len(files):
            shutil.rmtree(self.staging, ignore_errors=True)
            raise ValueError("members of one archive came to more than one task")
        for part, target in files:
            os.replace(part, target)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Archives)


def members(spark: SparkSession, path: str, prefix: str = "", suffix: str = "") -> DataFrame:
    """Members of the archives in a mounted folder, or of those that a pattern names, by the ends of their paths.

    Both are options of the source and not filters that Spark pushes into it: in the Spark that this was
    written with, a filter pushed into a Python source stays there for later queries on the same table.
    """
    register(spark)
    return spark.read.format("archives").options(prefix=prefix, suffix=suffix).load(path)


def written(all_members: DataFrame, folder: str) -> None:
    """Members as archives in a mounted folder, ``mimetype`` first; a task writes one after another, a member at a time."""
    register(all_members.sparkSession)
    os.makedirs(local(folder), exist_ok=True)
    late = F.col("path") != "mimetype"
    rows = all_members.select("book_id", "entry_no", "path", "compress_type", "content").repartition("book_id")
    rows.sortWithinPartitions("book_id", late, "entry_no").write.format("archives").mode("append").save(folder)
