"""Language identification as mixture inference by expectation-maximisation.

Training counts hashed byte trigrams of every labelled row, by language: per task first, then summed
by Spark; what reaches the driver is languages times BUCKETS numbers at most, whatever the corpus.
For a document, expectation-maximisation over its trigram counts estimates the share of each
language; languages enter the set one by one, the one with the largest share in the full mixture
first, as long as the likelihood penalised by the number of languages rises. The prediction is the
language with the largest share, its share the score.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and so is everything
if no row has a language to learn from; a null doc_id is neither held out nor learned from; ties go
to the first language by name; rows come back one for one; texts of any length are read
whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Letters, and few other characters that count as word characters (numbers as ½ or Ⅷ).
LETTER = re.compile(r"[^\W\d_]")
CHUNK = 1 << 20


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of the whole text, and how often each occurs."""
    raw = b" " + text.lower().encode("utf-8", "replace").translate(LETTERS) + b" "
    if len(raw) <= 1 << 14:
        return np.unique(_grams(raw), return_counts=True)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(raw), CHUNK):
        total += np.bincount(_grams(raw[at : at + CHUNK + 2]), minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


def _grams(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    key = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def has_letter(text: str) -> bool:
    """Whether any character is a letter of Unicode's (category L)."""
    return any(m.group().isalpha() for m in LETTER.finditer(text))


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for f in frames:
        for text, lang in zip(f["text"], f["lang"], strict=True):
            at, n = gram_counts(text)
            counts.setdefault(lang, np.zeros(BUCKETS, np.int64))[at] += n
    for lang, total in counts.items():
        at = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})


def learn(docs: DataFrame, train: Column) -> tuple[list[str], np.ndarray]:
    """Languages and the probabilities of trigram buckets in each, from all rows that train holds for."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sums = rows.mapInPandas(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    table = np.full((len(langs), BUCKETS), 0.1)
    for i, lang in enumerate(langs):
        own = sums[sums["lang"] == lang]
        table[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return langs, table / table.sum(axis=1, keepdims=True) if langs else table


def mixture(counts: np.ndarray, p: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Shares of the languages (rows of p) and the log-likelihood of the counts under them."""
    q = np.full(len(p), 1 / len(p))
    n = counts.sum()
    if len(p) > 1:
        for _ in range(rounds):
            q = q * (p @ (counts / (q @ p))) / n
    return q, float(counts @ np.log(q @ p))


def infer(text: str | None, langs: list[str], table: np.ndarray, penalty: float = 4.0) -> list[tuple[str, float]]:
    """Languages of the text with their shares, largest first.

    A language more must raise the log-likelihood by ``penalty`` times log of the trigrams: trigrams
    overlap, so the half of the usual criterion would admit too many.
    """
    if not langs or not text or not has_letter(text):
        return []
    at, counts = gram_counts(text)
    counts = counts.astype(float)
    p = table[:, at]
    shares, _ = mixture(counts, p)
    alone = counts @ np.log(p.T)
    first = int(np.argmax(alone))
    chosen, best, q = [first], float(alone[first]), np.ones(1)
    cost = penalty * np.log(max(counts.sum(), 2))
    for other in np.argsort(-shares, kind="stable"):
        if other == first:
            continue
        trial, likelihood = mixture(counts, p[[*chosen, other]])
        if likelihood - best <= cost:
            break
        chosen, best, q = [*chosen, int(other)], likelihood, trial
    order = sorted(range(len(chosen)), key=lambda i: (-q[i], langs[chosen[i]]))
    return [(langs[chosen[i]], float(q[i])) for i in order]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, keys: list[str]) -> DataFrame:
    """keys, lang_pred, score and mixture ("de:0.71,en:0.29") for each row of docs (keys, text)."""
    model = docs.sparkSession.sparkContext.broadcast((langs, table.astype(np.float64)))
    schema = docs.select(*keys).schema.add("lang_pred", "string").add("score", "double").add("mixture", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [infer(t.as_py(), *model.value) for t in batch.column(len(keys))]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[: len(keys)],
                pa.array([x[0][0] if x else "und" for x in found], pa.string()),
                pa.array([min(1.0, x[0][1]) if x else 0.0 for x in found], pa.float64()),
                pa.array([",".join(f"{name}:{q:.2f}" for name, q in x) for x in found], pa.string()),
            ], schema.names)

    return docs.select(*keys, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def language_table(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixture for each row of docs; held-out rows teach nothing."""
    langs, table = learn(docs, F.col("doc_id").isNotNull() & ~held_out())
    return predict(docs, langs, table, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "mixture")
