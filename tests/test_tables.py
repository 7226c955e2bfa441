"""Archives as a source with commit, trees and contents as tables."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import trees
from quire.sources import archive, package
from quire.sources.package import Toc

MEMBERS = [("mimetype", "application/epub+zip", 0), ("OPS/a.xhtml", "alpha", 8), ("OPS/b.xhtml", "beta", 8), ("img/c.png", "picture" * 50, 0)]


def some_books(spark, n=3):
    rows = [(f"book{b}", 9 - i, path, kind, bytearray(f"{text} {b}".encode())) for b in range(n) for i, (path, text, kind) in enumerate(MEMBERS)]
    return spark.createDataFrame(rows, package.MEMBERS)


def told(df):
    return sorted((r.book_id.rsplit("/", 1)[-1].removesuffix(".epub"), r.path, r.compress_type, bytes(r.content)) for r in df.collect())


def test_archives_written_and_read(spark, tmp_path):
    books = some_books(spark)
    archive.written(books, str(tmp_path))
    assert sorted(x.name for x in tmp_path.iterdir()) == ["book0.epub", "book1.epub", "book2.epub"]
    with zipfile.ZipFile(tmp_path / "book1.epub") as z:
        assert z.namelist() == ["mimetype", "img/c.png", "OPS/b.xhtml", "OPS/a.xhtml"]
    again = archive.members(spark, str(tmp_path))
    assert told(again) == told(books) == told(package.members(spark, f"{tmp_path}/*.epub"))
    for size in (1, 300, 10**6):
        got = spark.read.format("archives").option("partitionBytes", size).load(f"file://{tmp_path}")
        assert told(got) == told(books) and (got.rdd.getNumPartitions() == 1) == (size == 10**6)
    assert archive.members(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="mounted"):
        archive.members(spark, "hdfs://x/y").count()


def test_only_what_is_asked_for_is_inflated(spark, tmp_path):
    archive.written(some_books(spark, 1), str(tmp_path))
    name = tmp_path / "book0.epub"
    raw = bytearray(name.read_bytes())
    at = raw.index(b"picture")
    raw[at : at + 4] = b"XXXX"  # now its check sum is wrong: who inflates it fails
    name.write_bytes(bytes(raw))
    every = archive.members(spark, str(tmp_path))
    with pytest.raises(Exception, match="CRC"):
        every.collect()
    ops = archive.members(spark, str(tmp_path), "OPS/")
    assert sorted(r.path for r in ops.collect()) == ["OPS/a.xhtml", "OPS/b.xhtml"]
    assert ops.where(F.col("path").startswith("OPS/b")).count() == 1 and ops.count() == 2
    assert [r.path for r in archive.members(spark, str(tmp_path), suffix="b.xhtml").collect()] == ["OPS/b.xhtml"]
    with pytest.raises(Exception, match="CRC"):
        every.where(F.col("path").startswith("OPS/")).collect()  # a filter of Spark's own comes after the reading


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    bad = some_books(spark).withColumn("content", F.when(F.col("book_id") == "book2", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        archive.written(bad, str(tmp_path))
    assert list(tmp_path.iterdir()) == []
    archive.register(spark)
    apart = some_books(spark, 1).repartition(4, "path")
    with pytest.raises(Exception, match="more than one task"):
        apart.write.format("archives").mode("append").save(str(tmp_path))
    assert list(tmp_path.iterdir()) == []


def test_trees_from_parents(spark):
    rng = random.Random(4)
    rows, want = [], []
    for book in range(3):
        n = rng.randint(1, 60)
        parent = [None] + [rng.choice([i - 1, rng.randrange(i)]) for i in range(1, n)]
        children = {i: [j for j in range(n) if parent[j] == i] for i in range(n)}
        number = [0]

        def visit(i, path):
            lo = number[0]
            number[0] += 1
            for k, j in enumerate(children[i]):
                visit(j, [*path, k])
            want.append((book, i, len(path) - 1, path, lo, number[0] - 1))

        visit(0, [0])
        rows += [(book, i, parent[i], 0 if parent[i] is None else children[parent[i]].index(i)) for i in range(n)]
    nodes = spark.createDataFrame(rows, "book int, node int, parent int, child_no int")
    got = trees.placed(nodes, ["book"])
    assert sorted((r.book, r.node, r.depth, r.path, r.lo, r.hi) for r in got.collect()) == sorted(want)
    chain = spark.createDataFrame([(1, i, i - 1 if i else None, 0) for i in range(40)], nodes.schema)
    assert {(r.node, r.depth, r.lo, r.hi) for r in trees.placed(chain, ["book"]).collect()} == {(i, i, i, 39) for i in range(40)}
    # Without a node its whole subtree goes.
    assert trees.placed(chain.where("node != 17"), ["book"]).count() == 17
    assert trees.placed(chain.limit(0), ["book"]).count() == 0
    with pytest.raises(ValueError, match="ancestor"):
        trees.placed(spark.createDataFrame([(1, 0, None, 0), (1, 1, 2, 0), (1, 2, 1, 0)], nodes.schema), ["book"])


def test_matching_of_contents(spark):
    rng = random.Random(6)
    old, new, want = [], [], []
    some = lambda values: rng.choice([None, *values])
    for book in range(40):
        a = [Toc("o", some("xyz"), None, some("123")) for _ in range(rng.randint(0, 6))]
        b = [Toc("n", some("xyz"), None, some("123")) for _ in range(rng.randint(0, 6))]
        old += [(book, i, t.id, t.full_href) for i, t in enumerate(a)]
        new += [(book, i, t.id, t.full_href) for i, t in enumerate(b)]
        want += [(book, i, j) for i, j in enumerate(package.match_toc(a, b))]
    schema = "book int, at int, id string, full_href string"
    got = trees.matched(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["book"])
    assert sorted(((r.book, r.at, r.old_at) for r in got.collect()), key=str) == sorted(want, key=str)
