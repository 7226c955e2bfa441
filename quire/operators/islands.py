"""Neighbours and runs in ordered rows: shared prefixes, gaps and islands, ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import fences
from quire.sources.markup import renamed


def prefix_length(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.eqNullSafe(y))
    first_other = F.array_position(same, False)
    return F.when(a.isNull() | b.isNull() | (n <= 0), 0).when(first_other > 0, first_other - 1).otherwise(n).cast("int")


def common_depths(rows: DataFrame, keys: list[str], order: list[str], stack: str) -> DataFrame:
    """left_common and right_common: ancestors shared with the segment before and after; 0 at the edges."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = rows.withColumns({"_before": F.lag(stack).over(w), "_after": F.lead(stack).over(w)})
    return df.withColumns({"left_common": prefix_length(F.col(stack), F.col("_before")), "right_common": prefix_length(F.col(stack), F.col("_after"))}).drop("_before", "_after")


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """run_id: consecutive rows of one value are a run; the same value after another one starts a new run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("run_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def sparse_ids(rows: DataFrame, parent: list[str], tag: str, order: list[str], mark: str) -> DataFrame:
    """child_id: siblings of a tag are numbered only if their marks (fingerprints) differ; one counter per parent."""
    differ = F.size(F.collect_set(mark).over(Window.partitionBy(*parent, tag))) > 1
    df = rows.withColumn("_differ", differ)
    count = F.sum(F.col("_differ").cast("int")).over(Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("child_id", F.when(F.col("_differ"), count)).drop("_differ")


def renumber(rows: DataFrame, group: list[str], order: list[str], has_id: Column) -> DataFrame:
    """new_id: one counter through a group, over the rows that have an id."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("new_id", F.when(has_id, F.sum(has_id.cast("int")).over(w)))


def rename_duplicates(rows: DataFrame, keys: list[str], id_: str, order: list[str]) -> DataFrame:
    """rows with unique_id: in order, the first of an id keeps it, the n-th is renamed past all names given before (markup.renamed).

    Whether a name is free depends on all names before it, so a document (keys) is one group; null ids stay null.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order)
        has = f[id_].notna()
        f["unique_id"] = None
        f.loc[has, "unique_id"] = list(renamed(f.loc[has, id_]))
        return f

    return rows.groupBy(*keys).applyInPandas(run, T.StructType([*rows.schema.fields, T.StructField("unique_id", T.StringType())]))


def duplicate_ids(logs: DataFrame, key: str, text: str, kind: str = "xml") -> DataFrame:
    """key, id, n: ids that stand more than once below the root of a fenced block of a log; a block logged again counts once."""
    blocks = logs.select(key, F.explode(F.array_distinct(fences(F.col(text), kind))).alias("block")).withColumn("no", F.xxhash64("block"))
    inner = F.regexp_replace("block", "^\\s*<[^>]*>", "")
    ids = blocks.select(key, "no", F.explode(F.regexp_extract_all(inner, F.lit(r'<[^<>]*\sid="([^"]*)"'), 1)).alias("id"))
    return ids.groupBy(key, "no", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("no")


def incision_of(depth: Column, block_depth: Column, common: Column) -> Column:
    """Split preference at a boundary: 3 for each block left, 1 for each inline element."""
    return F.when(common >= block_depth, depth - common).otherwise(3 * (block_depth - common) + depth - block_depth)


def block_depth(tags: Column, inline: list[str]) -> Column:
    """1 + index of the deepest ancestor that isn't inline; 1 if all are."""
    at = F.transform(tags, lambda t, i: F.when(~F.lower(t).isin(*inline), i + 1).otherwise(1))
    return F.greatest(F.array_max(at), F.lit(1))
