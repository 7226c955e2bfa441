"""Phrases by levels against brute force and SQL; exact arithmetic beyond 64 bits."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm import collocations, queries

from . import helpers as H

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, least, most):
    f, n = {k: Counter() for k in (1, 2, 3)}, Counter()
    for r in rows:
        for piece in re.split("[.,;:!?\n\v\f\r]", H.folded(r[1])):
            w = re.findall("[^ \t]+", piece)
            lang = "und" if r[2] is None else r[2]
            n[lang] += len(w)
            for k in f:
                f[k].update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for k in (2, 3):
        for (lang, *w), a in f[k].items():
            if a < least:
                continue
            if k == 2 and any(100 * b >= 50 * a and b >= least and g[0] == lang and (list(g[1:3]) == w or list(g[2:]) == w) for g, b in f[3].items()):
                continue
            cuts = []
            for j in range(1, k):
                left, right = f[j][(lang, *w[:j])], f[k - j][(lang, *w[j:])]
                cuts.append((1000000 * a * a // (left * right), j, left, right))
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted(((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:most])), key=H.key)


@pytest.fixture(scope="module")
def rows():
    more = [(300 + i, t, lang, None, None) for i, (t, lang) in enumerate([("A b c. a B\tc! x\x00y é  a b c" * 7, "en"), ("un deux. trois un deux" * 12, None), ("a b\x0bc a b\rc a b", "de"), ("Ä ä b, Ä ä b" * 6, "de"), ("a a a a a a", "fr")] * 3)]
    return H.corpus() + more


@pytest.mark.parametrize("least, most, max_bits", [(3, 2000, 1 << 28), (3, 5, 1 << 28), (3, 2000, 1 << 16), (10, 2000, 1 << 28)])
def test_phrases(spark, rows, least, most, max_bits):
    got = collocations.phrases(H.clashing(H.frame(spark, rows)), least, most, max_bits)
    assert H.collected(got, *COLUMNS) == brute(rows, least, most)


def test_a_full_map_changes_nothing(spark, rows, monkeypatch):
    """With a map that lets everything through the levels are the same, only more is counted on the way."""
    docs = H.frame(spark, rows)
    want = [H.collected(x, "lang", "gram", "f") for x in collocations.levels(docs, 3)]
    monkeypatch.setattr(collocations, "frequent_map", lambda level, k, bits: (1 << 16, b"\xff" * (1 << 13)))
    assert [H.collected(x, "lang", "gram", "f") for x in collocations.levels(docs, 3)] == want


def test_only_grams_of_frequent_parts_are_emitted(spark):
    rows = [(i, "a b c" if i < 5 else f"a b x{i} b c", "en", None, None) for i in range(12)]
    docs = H.frame(spark, rows)
    one = collocations.counted(docs, 1, 10).where("gram is not null")
    assert sorted(r.gram for r in one.collect()) == ["a", "b", "c"]
    emitted = collocations.counted(docs, 2, 1, collocations.frequent_map(one, 1)).collect()
    assert sorted(r.gram for r in emitted) == ["a b", "b c"]  # no pair with an x


def test_empty(spark):
    assert collocations.phrases(H.frame(spark, [])).count() == 0
    assert collocations.phrases(H.frame(spark, [(1, None, None, None, None), (2, "", "en", None, None), (3, " . ", "en", None, None)])).count() == 0


def test_scores_beyond_64_bits(spark):
    cases = [(10, 10, 10), (10**15, 10**15, 10**15), (10**15 - 1, 10**15, 10**15), (3 * 10**14 + 7, 10**15 + 9, 7 * 10**14 + 1), (123456789012, 223456789013, 323456789011), (99, 100, 10**15)]
    got = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", F.expr(collocations.cut_score("a", "l", "r")).alias("score")).collect()
    assert [r.score for r in got] == [1000000 * r.a * r.a // (r.l * r.r) for r in got]


def test_against_sql(spark, sf_dir):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLES['op12_apriori_phrases']})").fetchall()
    assert H.collected(queries.QUERIES["op12_apriori_phrases"](spark, sf_dir), *COLUMNS) == sorted(want, key=H.key) and len(want) > 100
