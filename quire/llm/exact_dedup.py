"""Exact dedup by stateful streaming: keyed state of digests, checked against full bytes on hits.

Every document passes once through a streaming aggregation keyed by the digest of its normalised
text. The state (RocksDB on the executors' disks, changelogs in the shared folder) has no watermark,
so a key never expires; it keeps the digest, the stable identifier (smallest doc_id), the size of
the group and the content locator of the row that stays (length and a 64-bit checksum of the bytes
under that doc_id). Later feeds resume from the same state. A hit, a digest that the state holds more
than once, is then proved: the full normalised text is compared with that of the row that stays, and
rows that differ (a collision of digests) are grouped by their whole text instead.

Only DataFrame and SQL functions are used. Defined cases: null text counts as empty; texts of spaces
only normalise to one space, which differs from empty; rows with a null doc_id form groups as others
do, and a null stays only where the whole group has none; repeated rows (same doc_id and text) are
each returned, one of them kept; texts of any length are compared whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import common

#: Disk-backed state; small stores must not reserve disk space ahead of use.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """Runs of blank characters as one space; a single space is left as it is, which is the same and cheaper."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]{2,}|[\\t\\n\\x0B\\f\\r]", " ")


def digest_of(normal: Column) -> Column:
    return F.sha2(normal, 256)


def ingest(feed_path: str, state_path: str, spark: SparkSession) -> None:
    """Run what is new in the folder of feeds through the state, then stop.

    feed: digest string, doc_id long, n_bytes long, check long. The folder may grow between calls;
    files already counted are not read again.
    """
    schema = "digest string, doc_id long, n_bytes long, check long"
    old = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        state = (
            spark.readStream.schema(schema).parquet(feed_path).groupBy("digest")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "n_bytes", "check")).alias("first"), F.count(F.lit(1)).alias("n"))
        )
        state.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_path).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_of(spark: SparkSession, state_path: str) -> DataFrame:
    """The state as a table: digest, keep_id, n, n_bytes, check (the last two: the content locator)."""
    s = spark.read.format("statestore").load(state_path)
    first, n = (F.col("value")[x] for x in s.schema["value"].dataType.names[:2])
    return s.select(F.col("key.digest").alias("digest"), first["doc_id"].alias("keep_id"), n.alias("n"), first["n_bytes"].alias("n_bytes"), first["check"].alias("check"))


def exact_dedup(docs: DataFrame, digest=digest_of, state_path: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text).

    digest: from the normalised text to a string; a weak one only makes more hits to check.
    state_path: where the state is left; a new folder under spark.checkpoint.dir if not given.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("normal"))
    sha = F.sha2("normal", 256)
    own = digest is not digest_of
    rows = rows.select("doc_id", "normal", digest(F.col("normal")).alias("digest"), sha.alias("text_sha256"))
    feed_path = common.new_path(spark, "dedup-feed")
    rows.select("digest", "doc_id", F.octet_length("normal").cast("long").alias("n_bytes"), F.xxhash64("normal").alias("check"), *["text_sha256"] * own).write.parquet(feed_path)
    state_path = state_path or common.new_path(spark, "dedup-state")
    ingest(feed_path, state_path, spark)
    hits = common.table(state_of(spark, state_path).where("n > 1").select("digest", "keep_id", "n"), "dedup-hits")
    feed = spark.read.schema("digest string, doc_id long" + ", text_sha256 string" * own).parquet(feed_path)
    if not own:
        feed = feed.withColumn("text_sha256", F.col("digest"))
    alone = feed.join(hits, "digest", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(_proved(rows, hits))


def _proved(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows of digests that came more than once, by full bytes."""
    texts = common.table(common.marked(rows, hits, ["digest"]).where("_maybe").drop("_maybe"), "dedup-texts")
    stays = texts.join(hits, "digest").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # Of several texts under one digest and identifier the smallest text stands for the group.
    stays = common.table(stays.groupBy("digest", "keep_id", "n").agg(F.min("normal").alias("first_text")), "dedup-stays")
    same = F.col("normal") == F.col("first_text")
    checked = texts.join(stays, "digest").select("digest", "doc_id", "keep_id", "n", "text_sha256", same.alias("same"), F.when(~same, F.col("normal")).alias("other"))
    checked = common.table(checked, "dedup-checked")
    wrong = checked.where("not same").groupBy("digest").agg(F.count(F.lit(1)).alias("w"))
    agree = checked.where("same").join(wrong, "digest", "left").select("doc_id", "keep_id", (F.col("n") - F.coalesce("w", F.lit(0))).alias("group_size"), "text_sha256")
    differ = checked.where("not same")
    by_text = differ.groupBy(F.col("digest").alias("d"), F.col("other").alias("o")).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    differ = differ.select("digest", "doc_id", "other", "text_sha256").join(by_text, (F.col("digest") == F.col("d")) & (F.col("other") == F.col("o"))).select("doc_id", "keep_id", "group_size", "text_sha256")
    return _one_kept(agree.unionByName(differ))


def _one_kept(groups: DataFrame) -> DataFrame:
    """Repeated rows are counted, then dealt out again, the first of them kept."""
    counted = groups.groupBy("doc_id", "keep_id", "group_size", "text_sha256").agg(F.count(F.lit(1)).alias("m"))
    each = counted.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of equal texts the one with the smallest doc_id, with all its columns."""
    found = common.table(exact_dedup(docs).where("group_size > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("kept").alias("_kept")), "dedup-found")
    # The row as one struct: no name that docs may have is in the way.
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("key"), digest_of(normalised(F.col("text"))).alias("digest"))
    rows = common.marked(rows, found.select(F.col("_sha").alias("digest")), ["digest"])
    stay = found.where("_kept").distinct()
    unsure = rows.where("_maybe").join(found.select(F.col("_sha").alias("copy")).distinct(), F.col("digest") == F.col("copy"), "left")
    alone = unsure.where("copy is null")
    firsts = unsure.where("copy is not null").join(stay, (F.col("digest") == F.col("_sha")) & F.col("key").eqNullSafe(F.col("_id")), "left_semi")
    # Repeated rows of the one that stays: the first by all columns.
    one = firsts.withColumn("n", F.row_number().over(Window.partitionBy("digest", "key").orderBy(*[F.xxhash64(F.col("doc")[c]) for c in docs.columns]))).where("n = 1")
    return rows.where("not _maybe").select("doc.*").unionByName(alone.select("doc.*")).unionByName(one.select("doc.*"))
