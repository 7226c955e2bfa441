"""Operators that learn: held-out accuracy, and the parts that have one right answer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import language, toxicity

from . import helpers as H

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_language_held_out(spark, docs):
    got = language.language_table(docs).join(docs.select("doc_id", "lang", F.crc32(F.col("doc_id").cast("string")).alias("crc")), "doc_id")
    assert got.count() == docs.count() and got.where("held_out <> (crc % 3 = 1)").isEmpty()
    test = got.where("held_out")
    assert test.where("lang = lang_pred").count() >= 0.97 * test.count() and got.where("score < 0 or score > 1").isEmpty()


def test_language_odd_rows(spark):
    rows = H.corpus()
    got = language.language_table(H.clashing(H.frame(spark, rows)))
    assert got.count() == len(rows)
    assert {r.lang_pred for r in got.where("doc_id in (200, 201, 202)").collect()} == {"und"}
    none = language.language_table(H.frame(spark, [(1, "text", None, None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]
    assert language.language_table(H.frame(spark, [])).count() == 0


def test_texts_without_letters_have_no_language(spark):
    rows = [(i, t, lang, None, None) for i, (t, lang) in enumerate([("½", "es"), ("²", "es"), ("Ⅷ 12", "de"), ("_ -", "en"), ("ª", "es"), ("words of a language", "en"), ("x½", "en")] * 3)]
    got = {r.doc_id % 7: r.lang_pred for r in language.language_table(H.frame(spark, rows)).collect()}
    assert [got[i] for i in range(4)] == ["und"] * 4 and all(got[i] != "und" for i in (4, 5, 6))


def test_mixture_finds_the_shares():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.full(200, 0.2), 3) + 1e-9
    p /= p.sum(axis=1, keepdims=True)
    counts = rng.multinomial(4000, 0.7 * p[0] + 0.3 * p[2]).astype(float)
    q, _ = language.mixture(counts, p, 40)
    assert abs(q[0] - 0.7) < 0.05 and abs(q[2] - 0.3) < 0.05


def test_gram_counts_do_not_depend_on_chunks(monkeypatch):
    text = "Straße und mehr " * 3000
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "CHUNK", 1000)
    again = language.gram_counts(text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, again))


def test_toxicity_held_out(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.toxicity_table(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").toPandas()
    known = got[~got.held_out]
    assert (known.predicted == known.toxic).mean() > 0.9
    test = got[got.held_out]
    assert (test[test.toxic == 0].predicted == 0).mean() > 0.95 and test[test.toxic == 1].score.mean() > test[test.toxic == 0].score.mean() + 0.3
    # Held out at ten times the rows, where there are enough toxic ones to count.
    more = SF.replace("0.01", "0.1")
    labels = spark.read.parquet(f"{more}/labels.parquet")
    got = toxicity.toxicity_table(spark.read.parquet(f"{more}/documents.parquet"), labels).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").toPandas()
    assert (got[got.toxic == 1].predicted == 1).mean() >= 0.9 and (got[got.toxic == 0].predicted == 0).mean() >= 0.98


def test_words_of_any_length_teach(spark):
    word = "q" * 300 + "zzz"
    bad = [(f"{word} text {'abcdefghijkl'[i] * 4}", 1) for i in range(12)]
    fine = [(f"{'q' * 300}other text {'mnopqrstuvwx'[i % 12] * 3} {i}", 0) for i in range(40)]
    found = toxicity.learn_lexicon(spark.createDataFrame(bad + fine, "text string, toxic int"), 3, 2.0)
    assert f"={word}" in found


def test_toxicity_odd_rows(spark):
    rows = H.corpus()
    df = H.clashing(H.frame(spark, rows))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity_table(df, labels)
    assert got.count() == len(rows) and got.where("score is null or score < 0 or score > 1").isEmpty()
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.without_toxic(df, empty).columns == df.columns
    assert toxicity.toxicity_table(H.frame(spark, []), labels).count() == 0


def test_marks_by_bitmap_and_by_join_agree(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    labels = labels.unionByName(spark.createDataFrame([(-5, 1), (1 << 40, 0)], "doc_id long, toxic int"))
    texts = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-5, "x"), (1 << 40, "y")], "doc_id long, text string"))
    both = [H.collected(toxicity.with_marks(texts, labels, n), "doc_id", "toxic") for n in (4096, 0)]
    assert both[0] == both[1]


def test_lexicon_keeps_every_toxic_word(spark):
    import itertools

    words = ["".join(x) for x in itertools.product("bcdfg", "aeiou", "klmnp", "aeiou", "rstvw")][:3000]
    bad = [(f"{' '.join(words)} {chr(97 + i)}{'xyz'[i % 3] * 4}", 1) for i in range(12)]
    fine = [(f"{' '.join(w[:4] + 'q' for w in words)} plain {i}", 0) for i in range(40)]
    df = spark.createDataFrame(bad + fine, "text string, toxic int").repartition(2)
    found = toxicity.learn_lexicon(df, 1, 2.0)
    assert all("=" + w in found or any(w[:k] in found for k in range(3, 9)) for w in words)
    assert len(found) >= 3000


def test_grammar_marks():
    m = toxicity.Matcher({"moron": 4.0, "=trash": 3.0})
    marks = lambda text: [mark for _, events in m.clauses(text) for _, mark in events]
    assert marks("You are a moron.") == [toxicity.AIMED]
    assert marks("That is not trash") == [toxicity.NEGATED]
    assert marks("He said it was trash")[0] & toxicity.REPORTED
    assert marks('they wrote. then "morons" came')[0] & toxicity.REPORTED
    assert marks("plain words. more words") == [] and marks("trashy") == []
    threat = marks("I will kill you")
    assert threat and threat[0] & toxicity.THREATENED
    assert len(m.clauses("moron. moron! moron")) == 3
