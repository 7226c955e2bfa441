"""Suffix-array dedup: bytes of strings of ``size`` bytes that also start elsewhere are removed.

A run-compressed index of a whole corpus can't be built in bounded memory, so the corpus is first cut
along content. Every ``size``-byte window is assigned to an anchor, its smallest hashed 50-gram, which
equal windows share wherever they stand; consecutive windows of one anchor form a block. Anchors that
occur once can't hold a repeat and drop out in one count by hash. Blocks equal as a whole (128 bits of
checksum) are repeats, and all that their anchor has if it has no other kind of block. Of each kind of
the other anchors one block goes, with its bytes, to the task of its anchor, where a run-length index
(see run_length_index) of up to ``INDEX_BYTES`` of such blocks yields by matching statistics which
windows occur in another block too. An anchor with more than ``HOT`` kinds of block is not gathered in a
task: its windows are counted by 128-bit checksum instead, in salted groups, which is exact in the same
sense.

The result doesn't depend on how documents are dealt over tasks. Defined cases: null text is empty;
texts shorter than ``size`` bytes keep everything; repeated rows (same doc_id and text) are occurrences
of their own; null doc_ids are rows as others; an empty table gives no rows; texts of any
length are read whole, in chunks that share no window start; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import table
from quire.llm.run_length_index import RunLengthIndex

SIZE = 200
GRAM = 50
CHUNK = 1 << 20
HOT = 2000
INDEX_BYTES = 1 << 20
PLACE = np.uint64((1 << 21) - 1)

_rng = np.random.default_rng(20240229)
BYTE_HASH = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
MIX = _rng.integers(0, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the 50-grams that start at each byte; none for the last 49."""
    if len(raw) < GRAM:
        return np.zeros(0, np.uint64)
    h, width = BYTE_HASH[raw], 1
    for mix in MIX[:6]:
        step = min(width, GRAM - width)
        h = h[:-step] * mix + h[step:]
        h ^= h >> np.uint64(29)
        width += step
    h *= MIX[6]
    return h ^ (h >> np.uint64(32))


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of so many values, by doubling."""
    done, m = 1, x
    while 2 * done <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    rest = width - done
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def blocks_of(texts: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For the texts: index of the text, first and last window start of each block, anchor hash."""
    batch, offsets, total = [], [], 0
    for i, raw in enumerate(texts):
        if len(raw) < size:
            continue
        for at in range(0, len(raw) - size + 1, CHUNK - size + 1):
            part = raw[at : at + CHUNK]
            if total + len(part) > CHUNK and batch:
                yield from _blocks(batch, offsets, size)
                batch, offsets, total = [], [], 0
            batch.append(part if at + CHUNK < len(raw) else raw[at:])
            offsets.append((i, at))
            total += len(batch[-1])
            if at + CHUNK >= len(raw):
                break
    if batch:
        yield from _blocks(batch, offsets, size)


def _blocks(batch: list[bytes], offsets: list[tuple[int, int]], size: int) -> Iterator[tuple]:
    raw = np.frombuffer(b"".join(batch), np.uint8)
    lengths = np.array([len(b) for b in batch])
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    h = gram_hashes(raw)
    keyed = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    anchor = (_window_least(keyed, size - GRAM + 1) & PLACE).astype(np.int64)
    # Windows inside one chunk of a text only; the next chunk begins with the start after its last.
    which = np.repeat(np.arange(len(batch)), np.maximum(0, lengths - size + 1))
    first = np.concatenate([[0], np.cumsum(np.maximum(0, lengths - size + 1))[:-1]])
    starts = np.arange(len(which)) - first[which] + begin[which]
    a = anchor[starts]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (which[1:] != which[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(a)) - 1
    text = np.array([i for i, _ in offsets])[which[head]]
    shift = np.array([o for _, o in offsets])[which[head]] - begin[which[head]]
    yield text, starts[head] + shift, starts[tail] + shift, h[a[head]].astype(np.int64)


def _raw(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _anchor_counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, anchors in blocks_of(_raw(batch.column(0)), size):
                a, n = np.unique(anchors, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n)], ["anchor", "n"])

    return run


def _anchor_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _raw(batch.column(2))
            for text, first, last, anchors in blocks_of(texts, size):
                sums = [xxhash.xxh3_64_intdigest(texts[i][a : b + size]) for i, a, b in zip(text.tolist(), first.tolist(), last.tolist(), strict=True)]
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(anchors), pa.array(np.array(sums, np.uint64).astype(np.int64))],
                    ["doc_id", "row", "first", "last", "anchor", "block"],
                )

    return run


PLACES = "doc_id long, row long, first int, anchor long, block long, twice boolean"


def _contexts(size: int):
    """(doc_id, row, text, wanted blocks) to the bytes of cool blocks, and to checksums of each window of hot ones."""
    names = [x.split()[0] for x in PLACES.split(", ")] + ["bytes", "at", "w1", "w2"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, row, raw, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _raw(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                for w in wanted:
                    a, b = w["first"], w["last"]
                    place = (doc_id, row, a, w["anchor"], w["block"], w["twice"])
                    if not w["hot"]:
                        rows.append((*place, raw[a : b + size], None, None, None))
                    else:
                        for s in range(a, b + 1):
                            d = xxhash.xxh3_128_digest(raw[s : s + size])
                            rows.append((*place, None, s, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def _spans(hit: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()


def _matched(size: int, index_bytes: int):
    """Blocks (doc_id, row, first, anchor, block, twice, bytes) sorted by anchor to the spans of those that occur once.

    Whole anchors go into one index. Blocks that occur twice are there for the others to match.
    """
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))

    def flush(held: list[tuple]) -> pa.RecordBatch:
        index = RunLengthIndex([x[6] for x in held], [x[5] for x in held])
        long = index.matching() >= size
        rows = []
        for (doc_id, row, first, _, _, twice, raw), at in zip(held, index.starts.tolist(), strict=False):
            if not twice:
                spans = [{"a": first + a, "b": first + b + size} for a, b in zip(*_spans(long[at : at + len(raw) - size + 1]), strict=True)]
                if spans:
                    rows.append((doc_id, row, spans))
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "row", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][3:5] == row[3:5]:
                    continue  # the same block from a repeated row
                if total > index_bytes and held[-1][3] != row[3]:
                    yield flush(held)
                    held, total = [], 0
                held.append(row)
                total += len(row[6]) + 1
        if held:
            yield flush(held)

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for doc_id, raw, spans in zip(batch.column(0).to_pylist(), _raw(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            merged: list[list[int]] = []
            for s in sorted((x["a"], x["b"]) for x in spans or []):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            kept, at = [], 0
            for a, b in merged:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            rest = b"".join(kept)
            for column, value in zip(out, (doc_id, len(raw), len(raw) - len(rest), len(merged), rest), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


SPANS = "doc_id long, row long, spans array<struct<a:int,b:int>>"
SALTS = 32


def _counted(windows: DataFrame, size: int) -> DataFrame:
    """Spans of hot blocks that occur once, by how often their windows (places, at, w1, w2) occur.

    First among the blocks of one salt, then one row of each salt among those of the window, so that a
    window that stands in very many blocks isn't counted in one task.
    """
    group = Window.partitionBy("w1", "w2", "salt")
    # A repeated row brings its windows once more, but these are of blocks that occur twice anyway.
    salted = windows.withColumn("salt", F.pmod("block", F.lit(SALTS)))
    local = salted.withColumns({"n": F.sum(F.when(F.col("twice"), 2).otherwise(1)).over(group), "r": F.row_number().over(group.orderBy("block", "at"))})
    # Of blocks that occur twice the first row of a window is enough: it counts for the others.
    local = table(local.where("not twice or r = 1").select("doc_id", "row", "twice", "at", "w1", "w2", "n", "r"), "repeat-windows")
    one = local.where("r = 1").withColumn("all", F.sum("n").over(Window.partitionBy("w1", "w2"))).where("n = 1 and all > 1")
    found = local.where("n > 1 and not twice").select("doc_id", "row", "at").unionByName(one.select("doc_id", "row", "at"))
    starts = found.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("at")).alias("at"))
    before, after = (lambda i, d=d: F.get("at", i + d) for d in (-1, 1))
    firsts = F.filter("at", lambda x, i: (i == 0) | (before(i) != x - 1))
    lasts = F.filter("at", lambda x, i: F.coalesce(after(i) != x + 1, F.lit(True)))
    return starts.select("doc_id", "row", F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("a"), (b + size).alias("b"))).alias("spans"))


def repeat_spans(rows: DataFrame, size: int = SIZE, hot: int = HOT, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, row, spans of bytes [a, b) of repeats in rows (doc_id, row, text); they may overlap."""
    counts = rows.select("text").mapInArrow(_anchor_counts(size), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    often = table(counts.where("n > 1").select("anchor"), "repeat-anchors")
    blocks = rows.select("doc_id", "row", "text").mapInArrow(_anchor_rows(size), "doc_id long, row long, first int, last int, anchor long, block long")
    blocks = table(blocks.join(often, "anchor", "left_semi"), "repeat-blocks")
    kinds = table(blocks.groupBy("anchor", "block").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row", "first", "last")).alias("at")), "repeat-kinds")
    mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    wanted = kinds.join(mixed, "anchor").select("at.*", "anchor", "block", (F.col("n") > 1).alias("twice"), (F.col("m") > hot).alias("hot"))
    wanted = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct("first", "last", "anchor", "block", "twice", "hot")).alias("wanted"))
    same_row = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["row"] == wanted["row"])
    # Of repeated rows each brings the same bytes: one of them is enough, two would match each other.
    found = rows.join(wanted, same_row).select(rows["doc_id"], rows["row"], "text", "wanted").mapInArrow(_contexts(size), f"{PLACES}, bytes binary, at int, w1 long, w2 long")
    found = table(found, "repeat-contexts")
    names = [x.split()[0] for x in PLACES.split(", ")]
    cool = found.where("bytes is not null").select(*names, "bytes")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cool = cool.repartition(n, "anchor").sortWithinPartitions("anchor", "block").mapInArrow(_matched(size, index_bytes), SPANS)
    warm = _counted(found.where("bytes is null").select(*names, "at", "w1", "w2"), size)
    whole = blocks.join(kinds.where("n > 1").select("anchor", "block"), ["anchor", "block"], "left_semi")
    whole = whole.select("doc_id", "row", F.array(F.struct(F.col("first").alias("a"), (F.col("last") + size).alias("b"))).alias("spans"))
    return whole.unionByName(cool).unionByName(warm)


def without_repeats(docs: DataFrame, size: int = SIZE, **limits: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) for each row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit("row"), text).alias("row"), text.alias("text"))
    spans = repeat_spans(rows, size, **limits).groupBy("doc_id", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = table(spans, "repeat-spans")
    joined = rows.join(spans, rows["doc_id"].eqNullSafe(spans["doc_id"]) & (rows["row"] == spans["row"]), "left")
    return joined.select(rows["doc_id"], "text", "spans").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_table(docs: DataFrame, size: int = SIZE, **limits: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    df = without_repeats(docs, size, **limits)
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

