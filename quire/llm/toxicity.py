"""Toxicity by a weighted finite-state pattern grammar over clauses.

Lexicon: word stems and whole words whose rate in texts labelled toxic is far above that in the
others (log-odds), counted over all labelled training rows and required to occur in texts that
differ, so that copies of one text teach nothing. With hand-written threat verbs these are found in
one pass over a text; only clauses that hold one are read further.

Grammar: small transducers over the symbols of a clause (insult, threat, target, negation, reporting
verb, quote mark, other) run together as one composed machine. Each matched insult or threat comes
out with its weight and marks: aimed at a target, negated, reported. A document's features are the
weights gathered by mark; their weights in the score are fitted by ridge logistic regression on a
bounded sample of labelled rows (``fit_rows``).

Defined cases: null and empty texts match nothing and get the base score; a null doc_id is not held
out and, having no label, is never learned from; of several labels of one doc_id the highest counts;
without any toxic label the lexicon is empty and all scores are low; texts of any
length are scored whole; rows come back one for one; a
column named like ``into`` is replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import table, unused

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
AIMED, NEGATED, REPORTED, THREATENED = 1, 2, 4, 8
THREATS = "kill hurt destroy beat burn shoot stab punish töte töten schlage vernichte tuer frapper détruire brûler mataré matar golpear destruir".split()
TARGETS = "you your he him she her they them these those people du dich dir ihr euch sie er tu te toi vous lui elle ils elles eux tú usted ustedes él ella ellos ellas".split()
NEGATIONS = "not no never nor without isn't nicht kein keine keinen nie niemals ohne ne pas jamais sans aucun nunca jamás sin ningún".split()
REPORTS = "said says say called calls wrote claimed quoted sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió".split()
SYMBOL = {w.encode(): s for s, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}

STOPS = re.compile("[。！？…]")
MARKS = re.compile("[«»‐-‟‹›、-〿！-／]")
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ENDS = bytes(1 if c in b".!?;\n" else 0 for c in range(256))
TOKEN = re.compile(rb"[a-z\x80-\xff]+|\"")
WORD = re.compile(r"[^\W\d_]+")


# -- the grammar -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Transducer:
    """step(state, symbol) gives the next state and the marks it puts on an insult or threat at that symbol."""

    step: Callable[[int, int], tuple[int, int]]


def within(symbol: int, reach: int, mark: int) -> Transducer:
    """Marks what follows a symbol within so many tokens."""
    return Transducer(lambda left, s: (reach if s == symbol else max(0, left - 1), mark if left else 0))


def clause_wide(symbol: int, mark: int) -> Transducer:
    """Marks all that follows a symbol in the clause."""
    return Transducer(lambda seen, s: (int(seen or s == symbol), mark if seen else 0))


def quoted(mark: int) -> Transducer:
    """Marks what stands between quote marks."""
    return Transducer(lambda inside, s: (inside ^ (s == QUOTE), mark if inside else 0))


GRAMMAR = (within(TARGET, 4, AIMED), within(NEGATION, 3, NEGATED), clause_wide(REPORT, REPORTED), quoted(REPORTED), within(THREAT, 4, THREATENED))


@lru_cache(maxsize=1)
def composed() -> list[list[tuple[int, int]]]:
    """The product machine of GRAMMAR: table[state][symbol] = (next state, marks)."""
    start = (0,) * len(GRAMMAR)
    number, table, todo = {start: 0}, [], [start]
    while todo:
        state = todo.pop(0)
        row = []
        for symbol in range(7):
            parts = [t.step(s, symbol) for t, s in zip(GRAMMAR, state, strict=True)]
            to = tuple(p[0] for p in parts)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            marks = 0
            for p in parts:
                marks |= p[1]
            row.append((number[to], marks))
        table.append(row)
    return table


# -- the lexicon -----------------------------------------------------------------------------------


def _lowered(text: str) -> bytes:
    low = text.lower()
    if not low.isascii():
        low = MARKS.sub('"', STOPS.sub(".", low))
    return low.encode("utf-8", "replace")


def _count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(text, toxic) to words with the rows that have them by label, and 64 bits of which texts those are.

    A text's bit comes from its smallest word checksum, which near copies share.
    """
    counts: dict[str, list[int]] = {}
    held = 0  # characters of the words in counts

    def out() -> pd.DataFrame:
        frame = pd.DataFrame([(w, *c) for w, c in counts.items()], columns=["word", "n1", "n0", "texts"])
        counts.clear()
        return frame

    for f in frames:
        for text, toxic in zip(f["text"], f["toxic"], strict=True):
            words = set(WORD.findall((text or "").lower()))
            if not words:
                continue
            bit = min(zlib.crc32(w.encode("utf-8", "replace")) for w in words) % 64
            bit = (1 << bit) - (1 << 64) * (bit == 63)
            for w in words:
                c = counts.get(w)
                if c is None:
                    c = counts[w] = [0, 0, 0]
                    held += len(w)
                if toxic:
                    c[0] += 1
                    c[2] |= bit
                else:
                    c[1] += 1
            if len(counts) > 100_000 or held > 8 << 20:
                yield out()
                held = 0
    if counts:
        yield out()


def learn_lexicon(labelled: DataFrame, least: int, least_odds: float) -> dict[str, float]:
    """Log-odds of stems ("low") and whole words ("=low") that reach least_odds and say more than a shorter stem.

    least: rows and, roughly, different texts that a stem must occur in. The driver holds all such stems:
    at most one for each word and prefix that is so common in toxic texts.
    """
    words = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInPandas(_count_words, "word string, n1 long, n0 long, texts long")
    words = words.groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.bit_or("texts").alias("texts"))
    words = table(words, "toxic-words")
    total = words.agg(F.sum("n1"), F.sum("n0")).first()
    if not total[0]:
        return {}
    sizes = F.filter(F.array(*[F.lit(k) for k in range(3, 9)]), lambda k: k <= F.length("word"))
    stems = F.concat(F.array(F.concat(F.lit("="), "word")), F.transform(sizes, lambda k: F.substring("word", F.lit(1), k)))
    by_stem = words.select(F.explode(stems).alias("stem"), "n1", "n0", "texts").groupBy("stem").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.bit_or("texts").alias("texts"))
    odds = F.log((F.col("n1") + 0.5) / F.lit(float(total[0]))) - F.log((F.col("n0") + 0.5) / F.lit(float(total[1] or 0) + 1.0))
    best = by_stem.where((F.col("n1") >= least) & (F.bit_count("texts") >= least)).withColumn("odds", odds).where(F.col("odds") >= least_odds)
    best = table(best.select("stem", "odds"), "toxic-stems")
    # A longer stem or a word says nothing new where a shorter one is as strong.
    bare = F.ltrim(F.col("stem"), F.lit("="))
    longest = F.length(bare) - F.when(F.startswith("stem", F.lit("=")), 0).otherwise(1)
    shorter = F.transform(F.filter(F.array(*[F.lit(k) for k in range(3, 9)]), lambda k: k <= longest), lambda k: F.substring(bare, F.lit(1), k))
    said = best.select("stem", "odds", F.explode(shorter).alias("short")).join(best.select(F.col("stem").alias("short"), F.col("odds").alias("short_odds")), "short")
    said = said.where(F.col("short_odds") >= F.col("odds") - 0.7).select("stem").distinct()
    return {r["stem"]: r["odds"] for r in best.join(said, "stem", "left_anti").collect()}


# -- scoring ---------------------------------------------------------------------------------------

N_FEATURES = 7


class Matcher:
    def __init__(self, lexicon: dict[str, float]) -> None:
        import ahocorasick

        self._find = ahocorasick.Automaton()
        for stem, w in lexicon.items():
            key = f" {stem[1:]} " if stem[0] == "=" else f" {stem}"
            self._find.add_word(key.encode().decode("latin-1"), (len(key.encode()), w))
        for threat in THREATS:
            key = f" {threat} ".encode().decode("latin-1")
            if key not in self._find:
                self._find.add_word(key, (len(key), 0.0))
        self._find.make_automaton()

    def clauses(self, text: str) -> list[tuple[str, list[tuple[float, int]]]]:
        """Matched clauses with the weight and marks of each insult or threat in them."""
        raw = _lowered(text)
        hits: dict[int, float] = {}
        for end, (size, w) in self._find.iter(b" ".join((b"", raw.translate(LETTERS), b"")).decode("latin-1")):
            at = end - size + 1
            hits[at] = max(hits.get(at, 0.0), w)
        if not hits:
            return []
        ends = np.flatnonzero(np.frombuffer(raw.translate(ENDS), np.uint8))
        places = np.array(sorted(hits))
        found, table = [], composed()
        for k in np.unique(np.searchsorted(ends, places)):
            a = int(ends[k - 1]) + 1 if k else 0
            b = int(ends[k]) if k < len(ends) else len(raw)
            state, events, aimed_next = 0, [], -1
            for m in TOKEN.finditer(raw, a, b):
                w = hits.get(m.start(), 0.0)
                symbol = INSULT if w else QUOTE if m.group() == b'"' else SYMBOL.get(m.group(), OTHER)
                state, marks = table[state][symbol]
                if symbol == INSULT:
                    events.append([w, marks])
                    aimed_next = 3
                elif symbol == TARGET:
                    if aimed_next > 0:
                        events[-1][1] |= AIMED
                    if marks & THREATENED:
                        events.append([1.0, marks | AIMED])
                aimed_next -= 1
            if events:
                found.append((raw[a:b].decode("utf-8", "replace"), [(w, m) for w, m in events]))
        return found

    def features(self, text: str | None) -> list[float]:
        x = [1.0] + [0.0] * (N_FEATURES - 1)
        for _, events in self.clauses(text) if text else ():
            for w, marks in events:
                x[1] = max(x[1], w)
                x[2] += w
                for i, mark in enumerate((AIMED, NEGATED, REPORTED, THREATENED)):
                    if marks & mark:
                        x[3 + i] += w
        return [x[0], x[1] / 4, *(math.log1p(v) for v in x[2:])]


@dataclass(frozen=True)
class Model:
    lexicon: tuple[tuple[str, float], ...]
    weights: tuple[float, ...]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights), -30, 30)))


@lru_cache(maxsize=2)
def _matcher(lexicon: tuple[tuple[str, float], ...]) -> Matcher:
    return Matcher(dict(lexicon))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps from a prior that the strongest and summed weights raise the score, marks little."""
    prior = np.array([-3.0, 2.0, 1.0] + [0.0] * (N_FEATURES - 3))
    beta = prior.copy()
    keep = ridge * np.eye(N_FEATURES)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - keep @ (beta - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + keep
        beta = beta + np.linalg.solve(hess, grad)
    return beta


#: Bitmaps of labels up to this many are sent to the executors (8 KiB each, so 32 MiB); more are joined by shuffle.
MAP_ROWS = 4096


def with_marks(texts: DataFrame, marks: DataFrame, map_rows: int = MAP_ROWS) -> DataFrame:
    """texts (doc_id, text) that have a mark (doc_id, toxic), with it; texts stay where they are if the marks fit in bitmaps."""
    page = F.expr("(doc_id - pmod(doc_id, 32768)) div 32768")
    place = F.expr("pmod(doc_id, 32768)")
    maps = marks.select(page.alias("page"), place.alias("place"), "toxic").groupBy("page").agg(F.expr("bitmap_construct_agg(place)").alias("known"), F.expr("bitmap_construct_agg(place) filter (where toxic = 1)").alias("bad"))
    maps = table(maps, "toxic-marks")
    if maps.limit(map_rows + 1).count() > map_rows:
        return texts.join(marks, "doc_id")
    bit = "coalesce((shiftright(cast(conv(hex(substring({}, cast(_place div 8 as int) + 1, 1)), 16, 10) as int), cast(_place % 8 as int)) & 1) = 1, false)"
    placed = texts.withColumns({"_page": page, "_place": place}).join(F.broadcast(maps), F.col("_page") == F.col("page"))
    return placed.where(F.expr(bit.format("known"))).select("doc_id", "text", F.expr(bit.format("bad")).cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, train: Column, fit_rows: int = 20_000, least: int = 5, least_odds: float = 3.0) -> Model:
    """Learn from the rows of docs for which ``train`` (of doc_id) holds and labels has a toxic mark.

    fit_rows bounds the sample (by a hash of doc_id) that the weights of the score are fitted on;
    the stems are all that pass least and least_odds, and the counts behind them cover all labelled rows.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & train).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.where(train & F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lexicon = tuple(sorted(learn_lexicon(with_marks(texts, marks), least, least_odds).items()))
    n = marks.count()
    some = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < (1_000_000 if n <= fit_rows else 1_000_000 * fit_rows // n)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"x": [_matcher(lexicon).features(t) for t in f["text"]], "y": f["toxic"]})

    sample = with_marks(texts.where(some), marks.where(some)).mapInPandas(rows, "x array<double>, y int").collect()
    if not sample:
        return Model(lexicon, tuple(_logistic(np.zeros((0, N_FEATURES)), np.zeros(0))))
    return Model(lexicon, tuple(_logistic(np.array([r["x"] for r in sample]), np.array([r["y"] for r in sample], float))))


def with_score(docs: DataFrame, model: Model, into: str = "toxicity") -> DataFrame:
    """docs with a double ``into``: how likely its text is toxic."""
    fields = [f for f in docs.schema.fields if f.name != into]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matcher = _matcher(model.lexicon)
            x = np.array([matcher.features(t.as_py()) for t in batch.column(names.index("text"))]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x), pa.float64())], [*names, into])

    return docs.drop(into).mapInArrow(run, T.StructType([*fields, T.StructField(into, T.DoubleType())]))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; held-out rows teach nothing."""
    model = fit(docs, labels, ~held_out())
    df = with_score(docs.select("doc_id", "text"), model, "score")
    return df.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> DataFrame:
    """The rows of docs that score below 0.5."""
    model = fit(docs, labels, ~held_out() if train is None else train)
    into = unused(docs, "_toxicity")
    return with_score(docs, model, into).where(F.col(into) < 0.5).drop(into)
