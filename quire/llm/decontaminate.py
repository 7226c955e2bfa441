"""Benchmark decontamination by Wu-Manber search over words.

The patterns are all windows of ``window`` consecutive words of the benchmark items (an item of fewer
words is one window of its own length). For each length there is a shift table over hashed blocks of
two words: a block that stands nowhere in a pattern lets the search skip the most positions, another
one as many as keep it in line; where the shift is zero, the bucket of the suffix block holds the few
windows to compare directly with the text. Alphabet symbols are words, so a match is always one of
whole words.

Tables are flat arrays over the benchmark's text: some eight bytes for each of its bytes. The benchmark
is measured first: up to ``block_bytes`` of its text form one set of tables, sent to the executors; a
larger one is searched in blocks of that size, so nothing is cut off and neither driver nor executors
hold more than one block's tables. Each block is a pass that reads the texts and writes only what it found,
by checksum of the text; documents are written never, and joined with what all blocks found once. Defined
cases: null texts and texts without a word have no words and are not contaminated; texts of any length are searched whole; null items and items without words have no window; items that share an
item_id count as one, a null item_id as the empty string; null or repeated doc_ids are scanned row
by row; empty tables are scanned or leave all clean; a column named like ``into`` is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import WORD_BYTES, marked, sliced, table, unused

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
])
KIND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_BYTES).split()


class ShiftTable:
    """Windows of one length: shifts by block, buckets of distinct windows by suffix block, and the items of each."""

    def __init__(self, size: int, items: list[tuple[str, list[bytes]]]) -> None:
        self.size, self.block = size, min(2, size)
        self.names = [name for name, _ in items]
        self.raw = b"\n".join(b" ".join(words) for _, words in items)
        lengths = np.array([len(w) for _, words in items for w in words], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        n_words = np.array([len(words) for _, words in items], np.int64)
        item = np.repeat(np.arange(len(items)), n_words)
        place = np.arange(len(item)) - np.repeat(np.cumsum(n_words) - n_words, n_words)  # of a word in its item
        left = np.repeat(n_words, n_words) - place
        hashes = np.array([zlib.crc32(w) for _, words in items for w in words], np.uint32)
        if self.block == 2:
            hashes = np.array([zlib.crc32(b, zlib.crc32(a)) if b is not None else 0 for _, words in items for a, b in zip(words, [*words[1:], None], strict=True)], np.uint32)
        # A block's shift: how far its end is from the end of the nearest window, as each of its words begins one.
        inside = left >= self.block
        self.mask = (1 << max(12, (8 * len(hashes)).bit_length())) - 1
        shift = np.full(self.mask + 1, min(255, size - self.block + 1), np.uint8)
        np.minimum.at(shift, hashes[inside] & np.uint32(self.mask), np.clip(size - self.block - place[inside], 0, 255).astype(np.uint8))
        self.shift = shift.tobytes()
        first = np.flatnonzero(left >= size)
        suffix, whole = hashes[first + size - self.block], np.zeros(len(first), np.uint64)
        for k in range(0, max(1, size - self.block + 1)):
            whole = (whole ^ (whole >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[first + k]
        order = np.lexsort((item[first], whole, suffix))
        first, suffix, whole = first[order], suffix[order], whole[order]
        new = np.ones(len(first), bool)
        new[1:] = (suffix[1:] != suffix[:-1]) | (whole[1:] != whole[:-1])
        for i in np.flatnonzero(~new).tolist():
            # Windows of one hash are one window if they are the same in words; else each is its own.
            a, b = first[i - 1], first[i]
            new[i] = self.raw[starts[a] : ends[a + size - 1]] != self.raw[starts[b] : ends[b + size - 1]]
        head = np.flatnonzero(new)
        self.suffix = suffix[head]
        self.begin, self.end = starts[first[head]], ends[first[head] + size - 1]
        self.item, self.items_from = item[first].astype(np.int32), np.append(head, len(first))

    def found(self, block: int, pattern: bytes) -> set[str] | None:
        """Items of the window, if it is one: all windows with its suffix block are compared."""
        names = None
        at = int(np.searchsorted(self.suffix, np.uint32(block)))
        while at < len(self.suffix) and self.suffix[at] == block:
            if self.raw[self.begin[at] : self.end[at]] == pattern:
                own = {self.names[i] for i in np.unique(self.item[self.items_from[at] : self.items_from[at + 1]]).tolist()}
                names = own if names is None else names | own
            at += 1
        return names


def shift_tables(items: list[tuple[str, bytes]], window: int) -> list[ShiftTable]:
    """One table for each window length that occurs."""
    by_length: dict[int, list[tuple[str, list[bytes]]]] = {}
    for item, raw in items:
        words = words_of(raw)
        if words:
            by_length.setdefault(min(window, len(words)), []).append((item, words))
    return [ShiftTable(size, own) for size, own in sorted(by_length.items())]


def search(words: list[bytes], tables: list[ShiftTable]) -> tuple[list[int], set[str]]:
    """Starts and ends of the merged hit spans, one after another, and the items found."""
    spans, items = [], set()
    n, crc = len(words), zlib.crc32
    for t in tables:
        size, shift, mask = t.size, t.shift, t.mask
        at = size
        while at <= n:
            block = crc(words[at - 1], crc(words[at - 2])) if size > 1 else crc(words[at - 1])
            skip = shift[block & mask]
            if skip:
                at += skip
                continue
            hit = t.found(block, b" ".join(words[at - size : at]))
            if hit is not None:
                spans.append((at - size, at))
                items.update(hit)
            at += 1
    return _merged(spans), items


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, into: str = "leak", block_bytes: int = 8 << 20) -> DataFrame:
    """docs (with a column text) and a struct ``into``: n_words, n_hit, spans (starts and ends, in words), items (item_ids)."""
    spark = docs.sparkSession
    rest = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rest.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    blocks = size // block_bytes + 1

    def tables(part: DataFrame):
        return spark.sparkContext.broadcast(shift_tables([(r["item"], r["text"].encode()) for r in part.toLocalIterator()], window))

    if blocks == 1:
        return _scanned(docs.drop(into), tables(rest), into)
    # What a text holds depends on the text alone: each block gives rows for texts with hits, by their checksum, and documents are joined once.
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hits = []
    for b in range(blocks):
        part = _scanned(texts, tables(rest.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)), "leak").where("leak.n_hit > 0")
        hits.append(table(part.groupBy(F.sha2("text", 256).alias("digest")).agg(F.first("leak").alias("leak")), "leak-hits"))
    together = reduce(DataFrame.unionByName, hits).groupBy("digest").agg(
        F.first("leak.n_words").alias("n_words"), F.flatten(F.collect_list("leak.spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("leak.items")))).alias("items"))
    found = table(together.mapInArrow(_joined_spans, T.StructType([T.StructField("digest", T.StringType()), T.StructField(into, FOUND)])), "leak-hits")
    return _with_found(docs.drop(into), found, into)


def _joined_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of all blocks as spans that don't touch, and how many words they hold."""
    for batch in batches:
        rows = []
        for n, flat, items in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            spans = _merged([*zip(flat[::2], flat[1::2], strict=True)])
            rows.append({"n_words": n, "n_hit": sum(spans[1::2]) - sum(spans[::2]), "spans": spans, "items": items})
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, KIND)], ["digest", "found"])


def _with_found(docs: DataFrame, found: DataFrame, into: str) -> DataFrame:
    """docs with what was found for their texts; only rows whose checksum may be among those found go into the join."""
    # The row as one struct: no name that docs may have is in the way.
    counted = _scanned(docs, docs.sparkSession.sparkContext.broadcast([]), into)
    rows = counted.select(F.struct(*docs.columns).alias("doc"), F.col(into).alias("none"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("digest"))
    rows = marked(rows, found, ["digest"])
    joined = rows.where("_maybe").join(found.select("digest", F.col(into).alias("leak")), "digest", "left")
    out = joined.select("doc.*", F.coalesce("leak", "none").alias(into))
    return rows.where("not _maybe").select("doc.*", F.col("none").alias(into)).unionByName(out)


def _scanned(df: DataFrame, tables, into: str) -> DataFrame:
    names = df.columns
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = []
            for raw in batch.column(text_at).cast(pa.binary()):
                words = words_of(raw.as_py() or b"")
                spans, items = search(words, tables.value)
                found.append({"n_words": len(words), "n_hit": sum(spans[1::2]) - sum(spans[::2]), "spans": spans, "items": sorted(items)})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, KIND)], [*names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, FOUND)]))


def leak_table(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    df = scan_benchmark(docs.select("doc_id", "text"), benchmark, window)
    return df.select(
        "doc_id", "leak.n_words", "leak.n_hit", F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak.items", ","), 256).alias("items_sha256"), (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs."""
    into = unused(docs, "_leak")
    return scan_benchmark(docs, benchmark, window, into).where(F.col(into)["n_hit"] == 0).drop(into)


