"""Spelling variants against brute force, with groups of all sizes; the automata against sets of endings."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import spelling
from quire.llm.automaton import Automaton

from . import helpers as H

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def near(x, y):
    """One added, deleted or replaced code point, by trying them all."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute(rows, shortest=7, least=2, every=31, factor=10):
    count = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = H.folded(run)
            h = zlib.crc32(f"{'null' if r[0] is None else r[0]}:{run}".encode())
            if h % every == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            if len(run) >= shortest:
                count[run] += 1
    found = {w: n for w, n in count.items() if n >= least}
    forms, out = {}, []
    close = {w: [x for x in found if near(w, x)] for w in found}
    for w, n in found.items():
        best = min(close[w], key=lambda x: (-found[x], x), default=None)
        forms[w] = best if best is not None and found[best] >= factor * n else None
    for w, n in found.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, len(close[w]), None if forms[w] is None else found[forms[w]]))
    return sorted(out, key=H.key)


def texts(seed):
    """Words of few letters, so that most have near ones, some very common; rows with odd characters among them."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abÀé") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(60):
            x = list(rng.choice(base[:3] if rng.random() < 0.6 else base))
            if rng.random() < 0.2:
                x[rng.randrange(len(x))] = rng.choice("abcÀéÿ×")
            w.append("".join(x))
        rows.append((i, rng.choice([" ", ", ", "1", "你"]).join(w), "en", None, None))
    return rows + [(500, "a" * 300 + " " + "a" * 299 + " " + "a" * 300 + " b" + "a" * 299, "en", None, None), (501, "a" * 299, None, None, None), (None, "b" + "a" * 299 + " ABBAÀABA", None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return H.corpus() + texts(1)


@pytest.mark.parametrize("shortest, every, factor, limit, bucket", [(7, 31, 10, 50_000, 100_000), (7, 31, 3, 1, 300), (1, 3, 2, 20, 1000)])
def test_variants(spark, rows, shortest, every, factor, limit, bucket):
    got = spelling.variants(H.clashing(H.frame(spark, rows)), shortest, 2, every, factor, limit, bucket)
    want = brute(rows, shortest, 2, every, factor)
    assert H.collected(got, *COLUMNS) == want
    assert sum(w[4] > 1 for w in want) > 20 and (sum(w[1] is not None for w in want) > 3)


def test_forms_are_followed_to_the_last(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(18)] + [("x", "w3")]
    got = spelling.rooted(spark.createDataFrame(chain, "word string, form string"))
    assert {r.root for r in got.collect()} == {"w18"} and got.count() == 19
    assert spelling.rooted(spark.createDataFrame([], "word string, form string")).count() == 0


def test_empty(spark):
    assert spelling.variants(H.frame(spark, [])).count() == 0
    assert spelling.variants(H.frame(spark, [(1, None, None, None, None), (2, "", "en", None, None), (3, "short words", "en", None, None)])).count() == 0


def test_hot_halves_are_split(spark):
    """Two thirds of the words share their first half; no group keeps more than the limit."""
    rng = random.Random(5)
    names = {"prefix" + "".join(rng.choice("abcd") for _ in range(6)) for _ in range(400)} | {"".join(rng.choice("abcd") for _ in range(9)) for _ in range(200)}
    found = spark.createDataFrame([(w, 2) for w in names], "word string, n long")
    groups = spelling.split_hot(spelling.halves(found), 30)
    most = max(r["count"] for r in groups.where("hi - lo > 1").groupBy("key").count().collect())
    assert most <= 30
    got = {r.word: r.n_near for r in spelling.neighbours(found, 30, 500).collect()}
    assert got == {w: c for w in names if (c := sum(near(w, x) for x in names))}


@pytest.mark.parametrize("seed", range(5))
def test_automaton(seed):
    rng = random.Random(seed)
    names = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(60)})
    rows = spelling._matrix([w.encode() for w in names], 8)
    auto, trie = Automaton(rows), Automaton(rows, minimal=False)
    for a in (auto, trie):
        for k, w in enumerate(names):  # numbers are places in order
            state, number = np.array([a.root]), 0
            for c in w.encode():
                edge, there = a.step(state, np.array([c]))
                assert there[0]
                state, number = a.target[edge], number + int(a.before[edge][0])
            assert a.final[state][0] and number == k
    endings = defaultdict(set)
    for w in names:
        for i in range(len(w) + 1):
            endings[w[:i]].add(w[i:])
    assert len(auto.final) == len({frozenset(e) for e in endings.values()}) <= len(trie.final) == len(endings)
    for size in range(1, 7):
        asked = [w for w in names if len(w) == size]
        for exact in (0, size // 2, size):
            i, j = auto.one_error(spelling._matrix([w.encode() for w in asked], size) if asked else np.zeros((0, size), np.uint8), exact)
            want = {(x, y) for x in asked for y in names if near(x, y) and len(y) >= size and y[:exact] == x[:exact]}
            assert sorted((asked[a], names[b]) for a, b in zip(i, j)) == sorted(want)
