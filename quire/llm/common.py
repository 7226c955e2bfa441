"""What the operators share: written tables, ranks without one hot task, words."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes to bytes: A-Z in lower case, digits, letters and non-ASCII bytes as they are, all else a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_folders: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``, which all executors share.

    Where that setting is absent (tests, a single machine) a temporary folder serves, and only
    with a local master: on a cluster a machine's own folder would not be seen by the others.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quire-")
        _folders[app] = f"{base.rstrip('/')}/quire-{app}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Remove intermediate tables (of table()) that no later plan reads."""
    for df in tables:
        spark, files = df.sparkSession, df.inputFiles()
        if files:
            p = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: what a worker makes of a batch in Python objects stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str, buckets: int = 256, by: Column | None = None) -> DataFrame:
    """Adds ``name``: gapless long ranks from 0 within each group, by bucket and then ``order``.

    A group may hold most rows, so its rows are ranked within hash buckets (``by``, or all order
    columns) and each bucket starts where the ones before it end. The bucket counts are a small
    table: groups times ``buckets`` rows at most.
    """
    df = df.withColumn("_bucket", F.pmod(by if by is not None else F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = df.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, "_bucket").orderBy(*order)
    df = df.withColumn("_r", F.row_number().over(within) - 1)
    on = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group] + [F.col("_bucket") == F.col("_b")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.join(starts, cond).withColumn(name, (F.col("_start") + F.col("_r")).cast("long")).drop(*[f"_{g}" for g in group], "_b", "_bucket", "_start", "_r")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bits of the map that says which rows may be among some keys; fixed, so its 2 MiB bound what is broadcast.
MAP_BITS = 1 << 24


def marked(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """rows with a boolean ``_maybe``: true for all rows whose key is in keys, and for few others.

    Rows that are not marked need no join with keys, so their texts stay out of its shuffle.
    """
    slot = F.pmod(F.xxhash64(*key), F.lit(MAP_BITS))
    maps = keys.groupBy(F.bitmap_bucket_number(slot).alias("_map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits"))
    placed = rows.withColumns({"_at": F.bitmap_bucket_number(slot), "_pos": F.bitmap_bit_position(slot)})
    bit = "coalesce((shiftright(cast(conv(hex(substring(_bits, cast(_pos div 8 as int) + 1, 1)), 16, 10) as int), cast(_pos % 8 as int)) & 1) = 1, false)"
    return placed.join(F.broadcast(maps), F.col("_at") == F.col("_map"), "left").withColumn("_maybe", F.expr(bit)).drop("_at", "_pos", "_map", "_bits")
