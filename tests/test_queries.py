import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def shown(v):
    if v is None or v != v:
        return "~"
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_oracle(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in registry.ORACLES:
        assert got
        return
    rel = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(shown(r[names.index(c)]) for c in order) for r in rel.fetchall())
    assert sorted(tuple(shown(r[c]) for c in order) for r in got) == want


def test_entry_contract(spark):
    assert entry.entry(spark).columns == ["source", "volume", "group_no", "n_items", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streaming_groups_match_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from quire.operators import groups
    from quire.streaming.packing import budget_groups

    rows = [("a" if i % 3 else "b", i, (i * 7) % 11 + 1) for i in range(60)]
    items = spark.createDataFrame(rows, "key string, seq long, score long")
    items.unionByName(spark.createDataFrame([("a", 99, None), ("b", 99, None)], items.schema)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(items.schema).parquet(str(tmp_path / "in"))
    q = budget_groups(stream, 25).writeStream.format("memory").queryName("groups").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("groups").collect()))
    want = groups.budget_groups(items, ["key"], ["seq"], "score", 25).select("key", F.col("group_no").cast("long"), "n_items", "score")
    assert got == sorted(map(tuple, want.collect()))
