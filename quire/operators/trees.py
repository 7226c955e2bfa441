"""Trees as tables: paths and preorder intervals from (node, parent), contents matched in passes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.runs import Run


def placed(nodes: DataFrame, keys: list[str], node: str = "node", parent: str = "parent", order: str = "child_no", keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """nodes with depth, path (numbers of children from the root down), lo and hi (preorder numbers of a subtree, from 0).

    What lies below a parent that isn't among the nodes is left out: to drop subtrees, drop their roots. Each
    round joins what a node knows of its ancestors with what the highest of them knows, so the number of
    rounds grows with the logarithm of the depth. Each is written (keep), so plans don't grow. A node that is
    its own ancestor is an error.
    """
    spark = nodes.sparkSession
    keep = keep or Run(spark).keep
    rows = keep(nodes.select(*keys, node, F.col(parent).alias("_top"), F.array(F.col(order).cast("int")).alias("path"), F.array().cast("array<long>").alias("_above")), "tree-0")
    rounds = 0
    while not rows.where("_top is not null").isEmpty():
        rounds += 1
        if rounds > 63 or rounds > 1 and 2 ** (rounds - 2) > rows.count():
            raise ValueError("a node is its own ancestor")
        up = rows.select(*keys, F.col(node).alias("_top"), F.col("_top").alias("_next"), F.col("path").alias("_path"), F.col("_above").alias("_more"))
        below = rows.where("_top is not null").join(up, [*keys, "_top"])
        longer = below.select(*keys, node, F.col("_next").alias("_top"), F.concat("_path", "path").alias("path"), F.concat("_more", F.array(F.col("_top").cast("long")), "_above").alias("_above"))
        rows = keep(rows.where("_top is null").unionByName(longer), f"tree-{rounds}")
    below = rows.select(*keys, F.explode("_above").alias("_a")).groupBy(*keys, "_a").agg(F.count(F.lit(1)).alias("_n"))
    numbered = rows.withColumn("lo", F.row_number().over(Window.partitionBy(*keys).orderBy("path", node)) - 1)
    full = numbered.join(below.withColumnRenamed("_a", node), [*keys, node], "left")
    full = full.select(*keys, node, (F.size("path") - 1).alias("depth"), "path", "lo", (F.col("lo") + F.coalesce("_n", F.lit(0))).cast("int").alias("hi"))
    return nodes.join(full, [*keys, node])


def matched(old: DataFrame, new: DataFrame, keys: list[str], by: tuple[str, ...] = ("id", "full_href"), at: str = "at") -> DataFrame:
    """keys, at, old_at for each entry of new: the entry of old that it goes on, or null; each old one is used once.

    In passes over ``by`` the first new entry of a value takes the first old one that is free, the second the
    second and so on: ranks within a value are joined. What is left is matched in order. keys are the
    parent whose children are matched, so every window is over siblings.
    """
    rank = lambda df, *more: df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, *more).orderBy(at)))
    left, free, found = new.select(*keys, at, *by), old.select(*keys, at, *by), []
    for value in (*by, None):
        on = [value] if value else []
        a, b = (rank(df.where(F.col(value).isNotNull()) if value else df, *on) for df in (left, free))
        pairs = a.select(*keys, *on, "_rank", at).join(b.select(*keys, *on, "_rank", F.col(at).alias("old_at")), [*keys, *on, "_rank"])
        found.append(pairs.select(*keys, at, "old_at"))
        left = left.join(found[-1].select(*keys, at), [*keys, at], "left_anti")
        free = free.join(found[-1].select(*keys, F.col("old_at").alias(at)), [*keys, at], "left_anti")
    out = left.select(*keys, at, F.lit(None).cast(old.schema[at].dataType).alias("old_at"))
    for pairs in found:
        out = out.unionByName(pairs)
    return out
