"""Phrase collocation mining: Apriori passes by level, cuts scored from the level tables.

Level 1 counts the words of each language. Level k counts k-grams, but a task emits one only where both
of its overlapping (k-1)-grams are frequent: the frequent (k-1)-grams go to all tasks as a map of bits,
sized by their number (``BITS_EACH`` bits for each) up to ``MAX_MAP_BITS``, which bounds what is
broadcast at 32 MiB. The map may let a k-gram through that has an infrequent part, never the other way
round, and such a k-gram is infrequent itself, so all counts are exact whatever the map's size; where
there are more frequent grams than the map has room for, more k-grams are emitted and counted. Counts
are summed within a batch, then within a task, then by key.

Each candidate looks up the counts of the parts of its cuts in the level tables. A common word is a part
of very many candidates, so the candidates are salted and the small side repeated for each salt.
Products are decimals of 38 digits: exact up to a count of 10^15. The best phrases of a language are
ranked within salts first, so no task sorts all of its candidates.

Defined cases: a null text has no words; a null lang is ``und``; repeated rows count again; pieces end at
the marks, so no phrase crosses one, nor the end of a text; texts of any length are counted whole; ties
are broken by count, then by the phrase's bytes; an empty table gives an empty one; a language without a
candidate isn't in the result; columns other than text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import sliced, table

#: Bits of the map for each frequent gram, and the most that a map has (2^28 bits are 32 MiB).
BITS_EACH = 16
MAX_MAP_BITS = 1 << 28
SALTS = 8
#: Rows and characters that a task counts at once.
ROWS = 4000
CHARACTERS = 1 << 24

#: Bytes to bytes: A-Z in lower case, a tab is a space, all marks that end a piece are one.
END = b"."
_PIECES = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else END[0] if chr(c) in ".,;:!?\n\v\f\r" else c for c in range(256))
#: Fixed odd multipliers: of a gram's hash by its words.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def coded(texts: list[str | None]) -> tuple[np.ndarray, pa.Array, int]:
    """Of the words of all texts in order their codes, the words by code, and the code that stands between pieces."""
    joined = END.join([b"", *[t.encode() for t in texts if t], b""]).translate(_PIECES)
    parts = pc.split_pattern(pa.array([joined.replace(END, b" . ")], pa.binary()), b" ").flatten().dictionary_encode()
    codes, kinds = parts.indices.to_numpy(), parts.dictionary
    return codes[codes != pc.index(kinds, b"").as_py()], kinds, pc.index(kinds, END).as_py()


def batched(texts: Iterator[str | None], size: int) -> Iterator[list[str | None]]:
    """The texts in lists of about so many characters; a longer one is a list of its own."""
    own: list[str | None] = []
    total = 0
    for t in texts:
        if own and total + len(t or "") > size:
            yield own
            own, total = [], 0
        own.append(t)
        total += len(t or "")
    if own:
        yield own


def gram_slots(word_hashes: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The slot in a map of so many bits (a power of two) of each k-gram, from hashes of all words in order."""
    n = max(0, len(word_hashes) - k + 1)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = (h ^ word_hashes[i : i + n]) * _MIX[i]
        h ^= h >> np.uint64(29)
    return h & np.uint64(bits - 1)


def hashes_of(words: np.ndarray, lang: str) -> np.ndarray:
    """64-bit hashes of the words (bytes) of a language, the same in every process."""
    own = int(pd.util.hash_array(np.array([lang], dtype=object), categorize=False)[0]) % 10**16
    return pd.util.hash_array(words, hash_key=f"{own:016d}", categorize=False)


def frequent_map(level: DataFrame, k: int, max_bits: int = MAX_MAP_BITS) -> tuple[int, bytes]:
    """(bits, map) of the k-grams of a level (lang, gram): a task makes the part of each batch, the driver joins them."""
    n = level.count()
    bits = min(max_bits, max(1 << 16, 1 << (n * BITS_EACH - 1).bit_length()))
    block = min(bits, 1 << 15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.to_pandas()
            slots = []
            for lang, grams in f.groupby("lang")["gram"]:
                words = b" ".join(g.encode() for g in grams).split(b" ")
                slots.append(gram_slots(hashes_of(np.array(words, dtype=object), lang), k, bits)[::k])
            at = np.concatenate(slots) if slots else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], ["slot"])

    slots = level.select("lang", "gram").mapInArrow(run, "slot long")
    by_block = slots.groupBy(F.expr(f"slot div {block}").alias("block")).agg(F.bitmap_construct_agg(F.col("slot") % block).alias("bitmap"))
    out = bytearray(bits // 8)
    for r in by_block.collect():  # at most max_bits, in blocks of 4 KiB
        out[r["block"] * block // 8 : (r["block"] + 1) * block // 8] = r["bitmap"][: block // 8]
    return bits, bytes(out)


def counted(docs: DataFrame, k: int, least: int, below: tuple[int, bytes] | None = None) -> DataFrame:
    """lang, gram, f: the k-grams of docs (lang, text) that occur least times; at level 1 a row with a null gram holds the number of all words.

    below: the map of the frequent (k-1)-grams.
    """
    sent = docs.sparkSession.sparkContext.broadcast(below) if below else None

    def grams(lang: str, texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
        codes, kinds, end = coded(texts)
        if k == 1:
            n = np.bincount(codes, minlength=len(kinds))
            total = n.sum() - n[end]
            n[end] = 0
            at = np.flatnonzero(n)
            return pa.concat_arrays([kinds.take(pa.array(at)), pa.nulls(1, pa.binary())]), np.append(n[at], total)
        bits, bitmap = sent.value
        is_set = np.frombuffer(bitmap, dtype=np.uint8)
        slots = gram_slots(hashes_of(kinds.to_numpy(zero_copy_only=False), lang)[codes], k - 1, bits).astype(np.int64)
        frequent = (is_set[slots >> 3] >> (slots & 7)) & 1 == 1
        ends = codes == end
        whole = ~np.logical_or.reduce([ends[i : len(ends) - k + 1 + i] for i in range(k)])
        at = np.flatnonzero(frequent[:-1] & frequent[1:] & whole)
        key = codes[at].astype(np.int64)
        if k == 3:  # pairs first, so that no product passes 64 bits
            key = np.unique(key * len(kinds) + codes[at + 1], return_inverse=True)[1]
        _, first, n = np.unique(key * len(kinds) + codes[at + k - 1], return_index=True, return_counts=True)
        return pc.binary_join_element_wise(*[kinds.take(pa.array(codes[at[first] + i])) for i in range(k)], b" "), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS):
            by: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, all_of_it in by.items():
                for own in batched(all_of_it, CHARACTERS):
                    found, n = grams(lang, own)
                    for i in range(0, len(found), 100_000):
                        part = found[i : i + 100_000].cast(pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, pa.array(n[i : i + 100_000])], ["lang", "gram", "n"])

    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text").where("text is not null")
    sums = rows.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("f"))
    return sums.where((F.col("f") >= least) | F.col("gram").isNull())


def looked_up(rows: DataFrame, level: DataFrame, part: str, into: str) -> DataFrame:
    """rows with the count of their gram ``part``; the level table once for each salt, so that no common part has all its rows in one task."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    small = level.select(F.col("lang").alias("_lang"), F.col("gram").alias("_gram"), F.col("f").alias(into), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    return salted.join(small, (F.col("lang") == F.col("_lang")) & (F.col(part) == F.col("_gram")) & (F.col("_salt") == F.col("_s"))).drop("_salt", "_lang", "_gram", "_s", part)


def cut_score(a: str, left: str, right: str) -> str:
    """SQL of floor(1000000 * a * a / (left * right)), exact."""
    big = lambda c: f"cast({c} as decimal(19,0))"
    return f"cast(1000000 * ({big(a)} * {big(a)}) as decimal(38,0)) div cast({big(left)} * {big(right)} as decimal(38,0))"


def levels(docs: DataFrame, least: int = 10, longest: int = 3, max_bits: int = MAX_MAP_BITS) -> list[DataFrame]:
    """Tables (lang, gram, f) of the frequent grams of 1, 2, ... longest words; the first has the number of all words under a null gram."""
    found = [table(counted(docs, 1, least), "words")]
    for k in range(2, longest + 1):
        below = frequent_map(found[-1].where("gram is not null"), k - 1, max_bits)
        found.append(table(counted(docs, k, least, below), f"grams-{k}"))
    return found


def scored(one: DataFrame, two: DataFrame, three: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of all candidates, by the lowest-scoring cut, the first of several."""
    one = one.where("gram is not null")
    word = lambda i: F.split("phrase", " ", -1)[i]
    pairs = two.select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a")).withColumns({"w1": word(0), "w2": word(1)})
    pairs = looked_up(looked_up(pairs, one, "w1", "l"), one, "w2", "r").withColumn("score", F.expr(cut_score("a", "l", "r")))
    triples = three.select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"))
    triples = triples.withColumns({"w1": word(0), "w23": F.concat_ws(" ", word(1), word(2)), "w12": F.concat_ws(" ", word(0), word(1)), "w3": word(2)})
    for part, level, into in (("w1", one, "l1"), ("w23", two, "r1"), ("w12", two, "l2"), ("w3", one, "r2")):
        triples = looked_up(triples, level, part, into)
    cuts = F.expr(f"least(struct({cut_score('a', 'l1', 'r1')} as score, 1 as k, l1 as l, r1 as r), struct({cut_score('a', 'l2', 'r2')} as score, 2 as k, l2 as l, r2 as r))")
    triples = triples.withColumn("cut", cuts).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    return pairs.select(*triples.columns).unionByName(triples)


def standing(candidates: DataFrame, three: DataFrame) -> DataFrame:
    """Candidates without those inside a longer one that has at least half of their occurrences."""
    w = F.split("gram", " ", -1)
    inner = three.select("lang", "f", F.explode(F.array(F.concat_ws(" ", w[0], w[1]), F.concat_ws(" ", w[1], w[2]))).alias("phrase"))
    longer = inner.groupBy(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase")).agg(F.max("f").alias("_f"))
    kept = candidates.join(longer, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left")
    return kept.where("_f is null or 2 * _f < a").drop("_lang", "_phrase", "_f")


def top(rows: DataFrame, most: int) -> DataFrame:
    """rank (from 1) of the first ``most`` rows of each lang; first within salts, so that the last sort is of their bests alone."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    rows = rows.withColumn("_salt", salt)
    near = rows.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_r") <= most).drop("_r", "_salt")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def phrases(docs: DataFrame, least: int = 10, most: int = 2000, max_bits: int = MAX_MAP_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``most`` best phrases of 2 and 3 words of each language of docs (lang, text)."""
    one, two, three = levels(docs, least, 3, max_bits)
    totals = one.where("gram is null").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
    best = top(standing(scored(one, two, three), three), most)
    return best.join(totals, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
