"""Spelling variants: words that are near each other, grouped under their commonest forms.

Words are near if they part by one added, deleted or replaced letter. Of such a pair the shorter word (any
of two equally long ones) agrees with the other in its first or in its last half, letter by letter. So words
are brought together by (length of the shorter, that half), and a task searches them with a forward minimal
acyclic automaton, where the first half is walked exactly and the rest completed with one error, or with a
backward one (automaton.py); perfect-hash numbers give the words found. A pair found forward isn't taken
again backward. Where more than ``LIMIT`` words share a half, it doesn't go to one task: what may hold the
error is halved again, with both ends exact, until no group is larger; a group whose error is at one place
holds at most 9,000 words (two letters out of 90), so this always ends, and no pair is lost.

Tasks take groups by hash, in as many buckets as the number of words asks for, and give for each word
how many near ones they found and the commonest; these are summed by word. Forms are followed by joins that
double their reach; a form has ten times the occurrences of its word, so 18 steps are the most there can be.

Defined cases: null and empty texts have no words; a null doc_id is written ``null`` for the check sum;
repeated rows count again; words and texts of any length are taken whole; ties between near words go to the
first in code-point order; a word without a near one has null for form and itself for root; an empty
table gives an empty one; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.automaton import Automaton
from quire.llm.common import dropped, sliced, table

LIMIT = 50_000
BUCKET = 100_000
#: Letters of a task's search that are held at once.
CHUNK = 1 << 20
#: Of the most hot halves that are broadcast: there is one for LIMIT rows at most.
MOST_SENT = 200_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def runs_of(doc_id: int | None, text: str, shortest: int, every: int) -> Counter:
    """Counts of a text's words: runs of letters in lower case, of every 31st by check sum one letter is lost."""
    runs = Counter(re.findall(f"[a-zÀ-ÿ]{{{shortest},}}", text.encode().translate(_LOWER).decode()))
    seed = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
    out = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), seed)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < shortest:
                continue
        out[run] += n
    return out


def words(docs: DataFrame, shortest: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """word, n of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            total = Counter()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.update(runs_of(doc_id, text, shortest, every))
            yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# -- groups that share all but the region of the error -----------------------------------------------


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, size, lo, hi) with the key of what they share: all of a word but letters lo to hi of the shorter one."""
    ends = F.expr("struct(size, lo, hi, substr(word, 1, lo), substr(word, length(word) - (size - hi) + 1, size - hi))")
    return rows.withColumn("key", F.xxhash64(ends))


def halves(found: DataFrame) -> DataFrame:
    """word, n, size, lo, hi, key: each word as the shorter or the longer one of a pair, with the error in its last or its first half."""
    sizes = found.withColumn("size", F.explode(F.expr("array(length(word), length(word) - 1)"))).where("size > 0")
    half = F.expr("cast(size div 2 as int)")
    regions = F.array(F.struct(half.alias("lo"), F.col("size").alias("hi")), F.struct(F.lit(0).alias("lo"), half.alias("hi")))
    rows = sizes.withColumn("region", F.explode(regions)).select("word", "n", "size", "region.lo", "region.hi").where("hi > lo")
    return _keyed(rows)


def split_hot(rows: DataFrame, limit: int) -> DataFrame:
    """rows, those of keys with more than limit words with their regions halved until no key has more, or the region is one letter."""
    done = []
    while True:
        hot = table(rows.where("hi - lo > 1").groupBy("key").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > limit).select("key", F.lit(True).alias("hot")), "spelling-hot")
        n = hot.count()
        if not n:
            return reduce(DataFrame.unionByName, done, rows)
        marked = rows.join(F.broadcast(hot) if n <= MOST_SENT else hot, "key", "left")
        done.append(marked.where("hot is null").drop("hot"))
        middle = F.expr("cast((lo + hi) div 2 as int)")
        parts = F.array(F.struct(middle.alias("lo"), "hi"), F.struct("lo", middle.alias("hi")))
        rows = table(_keyed(marked.where("hot").withColumn("part", F.explode(parts)).select("word", "n", "size", "part.lo", "part.hi")), "spelling-rows")


def _matrix(strings: list[bytes], width: int) -> np.ndarray:
    return np.array(strings, dtype=f"S{width}").view(np.uint8).reshape(len(strings), width)


def near_pairs(found: list[bytes], size: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of words with one error within letters lo to hi of word i, which has ``size`` of them; j has as many or one more.

    A pair that has an error after hi as well as one within, so to say, is left to the region after it.
    """
    tail = size - hi
    turned = (lambda w: w) if not tail else (lambda w: w[::-1]) if not lo else (lambda w: w[len(w) - tail :] + w[: len(w) - tail])
    z = np.array([turned(w) for w in found], dtype=f"S{size + 1}")
    order = np.argsort(z, kind="stable")
    rows = z[order].view(np.uint8).reshape(len(found), size + 1)
    auto = Automaton(rows)
    asked = np.flatnonzero(rows[:, size] == 0)
    whole = _matrix([found[i] for i in order], size + 1)
    pairs = []
    for at in range(0, len(asked), max(1, CHUNK // size)):
        who = asked[at : at + max(1, CHUNK // size)]
        i, j = auto.one_error(rows[who, :size], lo + tail)
        i = who[i]
        if tail:
            apart = (whole[i, :hi] != whole[j, :hi]).any(axis=1)
            i, j = i[apart], j[apart]
        pairs.append((order[i], order[j]))
    return (np.concatenate([i for i, _ in pairs]), np.concatenate([j for _, j in pairs])) if pairs else (order[:0], order[:0])


def _searched(f: pd.DataFrame) -> pd.DataFrame:
    """word, n_near, near_n, near: what the groups of a bucket hold."""
    out = []
    f = f[f.duplicated("key", keep=False)]
    for (size, lo, hi), g in f.groupby(["size", "lo", "hi"]):
        names = g["word"].to_numpy()
        latin = [w.encode("latin-1") for w in names]
        i, j = near_pairs(latin, int(size), int(lo), int(hi))
        # What the shorter one finds, the longer one has found too; two equally long ones find each other.
        longer = np.fromiter(map(len, latin), dtype=np.int64, count=len(latin))
        back = longer[i] < longer[j]
        a, b = np.concatenate([i, j[back]]), np.concatenate([j, i[back]])
        if not len(a):
            continue
        n = g["n"].to_numpy()
        rank = np.empty(len(names), dtype=np.int64)
        rank[np.argsort(np.array(latin, dtype=f"S{size + 1}"), kind="stable")] = np.arange(len(names))
        order = np.lexsort((rank[b], -n[b], a))
        a, b = a[order], b[order]
        who, at, many = np.unique(a, return_index=True, return_counts=True)
        out.append(pd.DataFrame({"word": names[who], "n_near": many, "near_n": n[b[at]], "near": names[b[at]]}))
    return pd.concat(out) if out else pd.DataFrame({"word": pd.Series(dtype=str), "n_near": pd.Series(dtype="int64"), "near_n": pd.Series(dtype="int64"), "near": pd.Series(dtype=str)})


def neighbours(found: DataFrame, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """word, n_near, near, near_n: of each word of found (word, n) that has near ones their number and the commonest."""
    n_buckets = max(1, -(-4 * found.count() // bucket))
    rows = split_hot(halves(found), limit).withColumn("bucket", F.pmod("key", F.lit(n_buckets)))
    parts = rows.groupBy("bucket").applyInPandas(lambda f: _searched(f), "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms (word, form) that one comes to."""
    hops = table(forms.select("word", F.col("form").alias("root")), "spelling-hops")
    for _ in range(5):  # 32 steps; there are 18 at most
        on = hops.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        longer = table(hops.join(on, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "spelling-hops")
        dropped(hops)
        hops = longer
        if hops.where("moved").isEmpty():
            break
    return hops.select("word", "root")


def variants(docs: DataFrame, shortest: int = 7, least: int = 2, every: int = 31, factor: int = 10, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of docs (doc_id, text)."""
    found = table(words(docs, shortest, least, every), "spelling-words")
    near = table(neighbours(found, limit, bucket), "spelling-near")
    full = found.join(near, "word", "left")
    formed = F.col("near_n") >= factor * F.col("n")
    full = table(full.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")), "spelling-forms")
    roots = rooted(full.where("form is not null"))
    return full.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
