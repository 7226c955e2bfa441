"""Edit-aware token counts: a segment tree of pre-token runs per document.

The leaves of a tree are runs of pre-tokens with their characters and tokens; inner nodes hold sums,
so the root has the document's count. An edit finds its leaves by descending on characters. Only
these are split and encoded again, with context: back to a leaf that holds a character other than
white space (a pre-token may depend on the one that follows), and on until the new split meets a
boundary of the old one, from where all is as before. Then the sums above the changed leaves are
updated. A leaf that has grown too long makes the tree be built anew.

Trees are kept as two arrays (characters and tokens by leaf), so a later feed of edits goes on from
them without encoding the text again. Defined cases: null text is empty, null edits are none; edits
are applied in order, each on the text that the one before left; positions and lengths are cut to the
text; null or repeated doc_ids are counted row by row; an empty table gives no rows;
texts of any length are counted whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import tokens

LEAF = 32
SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]*")


class SegmentTree:
    """Sums over leaves in an array: node i has the children 2i and 2i + 1."""

    def __init__(self, leaves: list[tuple[int, int]]) -> None:
        self.n = len(leaves)
        self.width = 1 << max(0, (max(1, self.n) - 1).bit_length())
        self.chars = [0] * (2 * self.width)
        self.tokens = [0] * (2 * self.width)
        for i, (c, t) in enumerate(leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = c, t
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def leaves(self) -> list[tuple[int, int]]:
        return list(zip(self.chars[self.width : self.width + self.n], self.tokens[self.width : self.width + self.n], strict=True))

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character position (the last one for the end), and where it begins."""
        i, begin = 1, 0
        while i < self.width:
            i *= 2
            if at >= begin + self.chars[i] and self.chars[i + 1]:
                begin += self.chars[i]
                i += 1
        return i - self.width, begin

    def put(self, first: int, new: list[tuple[int, int]]) -> None:
        """New values of leaves from first on; sums are updated on the way up only."""
        for k, (c, t) in enumerate(new):
            self.chars[self.width + first + k], self.tokens[self.width + first + k] = c, t
        lo, hi = (self.width + first) // 2, (self.width + first + len(new) - 1) // 2
        while lo:
            for i in range(lo, hi + 1):
                self._sum(i)
            lo, hi = lo // 2, hi // 2


class CountedText:
    """A text with its tree; edits keep both in step."""

    def __init__(self, text: str, encoder: tokens.Encoder, leaves: list[tuple[int, int]] | None = None) -> None:
        self.text, self._encoder, self.encoded = text, encoder, 0
        self.tree = SegmentTree(leaves if leaves is not None else self._leaves(text))

    @property
    def count(self) -> int:
        return self.tree.tokens[1]

    def _size(self, piece: str) -> int:
        return len(self._encoder.pieces[piece]) // 4

    def _leaves(self, text: str) -> list[tuple[int, int]]:
        pieces = self._encoder.split(text)
        self.encoded += len(text)
        return [(sum(map(len, run)), sum(map(self._size, run))) for run in (pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF))] or [(0, 0)]

    def edit(self, at: int, remove: int, insert: str) -> None:
        old, tree = self.text, self.tree
        at = min(max(at, 0), len(old))
        remove = min(max(remove, 0), len(old) - at)
        self.text = old[:at] + insert + old[at + remove :]
        shift = len(insert) - remove
        first, begin = tree.find(at)
        while first and (SPACE.fullmatch(old, begin, at) or begin == at):
            first -= 1
            begin -= tree.chars[tree.width + first]
        # One leaf more as context, with a character other than white space in it.
        if first:
            first -= 1
            begin -= tree.chars[tree.width + first]
            while first and SPACE.fullmatch(old, begin, begin + tree.chars[tree.width + first]):
                first -= 1
                begin -= tree.chars[tree.width + first]
        last, end = tree.find(min(at + remove, len(old)))
        end += tree.chars[tree.width + last]
        while True:
            # Split one leaf further than is replaced, so that the last boundary is sure.
            ahead = end + (tree.chars[tree.width + last + 1] if last + 1 < tree.n else 0)
            last_leaf = last + 1 >= tree.n
            pieces = self._encoder.split(self.text[begin : ahead + shift + 1 if not last_leaf else None])
            cut, done = 0, None
            for k, piece in enumerate(pieces):
                if begin + cut == end + shift:
                    done = k
                    break
                cut += len(piece)
            if last_leaf:
                done = len(pieces)
            if done is not None:
                break
            last += 1
            end += tree.chars[tree.width + last]
        pieces = pieces[:done]
        self.encoded += sum(map(len, pieces))
        room = last - first + 1
        per = -(-len(pieces) // room)
        if per > 4 * LEAF:
            self.tree = SegmentTree(tree.leaves()[:first] + [(sum(map(len, r)), sum(map(self._size, r))) for r in (pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF))] + tree.leaves()[last + 1 :])
            return
        runs = [pieces[k * per : (k + 1) * per] for k in range(room)]
        tree.put(first, [(sum(map(len, r)), sum(map(self._size, r))) for r in runs])


TREE = T.StructType([T.StructField("leaf_chars", T.ArrayType(T.IntegerType())), T.StructField("leaf_tokens", T.ArrayType(T.IntegerType()))])
EDIT = "array<struct<at:int,remove:int,insert:string>>"


def count_edits(docs: DataFrame, edits: Column, path: str | None = None, tree: Column | None = None) -> DataFrame:
    """doc_id, n_tokens_before, n_tokens, n_edits, n_chars, n_encoded, text and tree after the edits.

    edits: an array of (at, remove, insert) in order, or null. tree: what an earlier call returned for
    the text; without it the text is encoded once. n_encoded: characters encoded in this call for edits.
    """
    path = path or tokens.tokenizer_path()
    none = F.lit(None).cast("struct<leaf_chars:array<int>,leaf_tokens:array<int>>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), edits.cast(EDIT).alias("edits"), (none if tree is None else tree).alias("tree"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("n_tokens_before", "n_tokens", "n_edits", "n_chars", "n_encoded")), T.StructField("text", T.StringType()), T.StructField("tree", TREE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, text, todo, kept in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                leaves = list(zip(kept["leaf_chars"], kept["leaf_tokens"], strict=True)) if kept else None
                counted = CountedText(text or "", encoder, leaves)
                before, counted.encoded = counted.count, 0
                for e in todo or []:
                    counted.edit(e["at"] or 0, e["remove"] or 0, e["insert"] or "")
                leaves = counted.tree.leaves()
                row = (doc_id, before, counted.count, len(todo or []), len(counted.text), counted.encoded, counted.text, {"leaf_chars": [c for c, _ in leaves], "leaf_tokens": [t for _, t in leaves]})
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 6 + [pa.string(), pa.struct([("leaf_chars", pa.list_(pa.int32())), ("leaf_tokens", pa.list_(pa.int32()))])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], schema.names)

    return rows.mapInArrow(run, schema)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with the edits (doc_id, seq, at, remove, insert) of each row in order, as column ``edits``.

    Rows that share a doc_id each get its edits, rows with a null doc_id those with a null one; a column
    of docs that is named edits already is replaced.
    """
    lists = edits.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "at", "remove", "insert"))), lambda e: F.struct(e["at"], e["remove"], e["insert"])).alias("edits"))
    lists = lists.withColumnRenamed("doc_id", "_edited")
    return docs.drop("edits").join(lists, docs["doc_id"].eqNullSafe(lists["_edited"]), "left").drop("_edited")


def drawn_edits(n: int = 3) -> Column:
    """n edits per row that doc_id and length decide: a replacement, an insertion and a deletion by turns."""
    length = F.length(F.coalesce(F.col("text"), F.lit("")))
    draw = lambda k: F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(k))))
    inserts = ("rewritten ", " a new sentence, twice.\n", "")
    return F.array(*[F.struct(F.pmod(draw(k), length + 1).cast("int").alias("at"), F.lit(0 if k % 3 == 1 else 9 + k).alias("remove"), F.lit(inserts[k % 3]).alias("insert")) for k in range(n)])


def edit_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens_before, n_tokens, n_edits, n_chars, n_encoded under the drawn edits."""
    return count_edits(docs, drawn_edits()).drop("text", "tree")
