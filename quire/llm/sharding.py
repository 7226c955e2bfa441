"""Sharding by balanced label propagation.

Rows are linked through hubs (here: equal texts). They start in hashed, even shards. In each round a
join with the shard counts of its hub tells every linked row the shard where most of its neighbours
are (of the shards with room); how many rows may go from one shard to another is a quota worked out from counts by (from, to,
gain), a table whose size doesn't grow with the data: pairs of shards exchange equal numbers, and what
room the capacity leaves is added, the largest gains first. Rounds stop when no move gains. At the end
the law ``rows`` is made exact: each shard keeps its quota of rows, linked ones first, and what is over
fills the gaps of the others.

A hub may hold a third of all rows, more than a shard: its rows fill the shards it can, and joins and
ranks split it (adaptive joins; ranks by hash buckets). Defined cases: null text has size 1 and
checksum 0; null texts are linked with one another; null or repeated doc_ids are placed row by row; an
empty table gives no rows; other columns are ignored;
texts of any length count by their bytes; of shards that draw a hub equally one is taken by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ranked, table

HOT_HUB = 1000


def _quotas(want: dict[tuple[int, int, int], int], sizes: list[int], capacity: int) -> dict[tuple[int, int], tuple[int, float]]:
    """For (from, to): the least gain of which all may go, and the share that may go of the gain below."""
    total: dict[tuple[int, int], int] = {}
    for (i, j, _), n in want.items():
        total[i, j] = total.get((i, j), 0) + n
    allowed = {(i, j): min(n, total.get((j, i), 0)) for (i, j), n in total.items()}
    room = [max(0, capacity - s) for s in sizes]
    for (i, j), n in sorted(total.items()):
        more = min(n - allowed[i, j], room[j])
        allowed[i, j] += more
        room[j] -= more
    out = {}
    for (i, j), left in allowed.items():
        for gain in sorted({g for a, b, g in want if (a, b) == (i, j)}, reverse=True):
            n = want[i, j, gain]
            if left < n:
                out[i, j] = (gain + 1, left / n)
                break
            left -= n
        else:
            out[i, j] = (0, 0.0)
    return out


def propagate(state: DataFrame, shards: int, rounds: int, slack: float) -> DataFrame:
    """state (key, hub, n_hub, shard, ...) with its rows moved towards their neighbours' shards."""
    sizes_of = lambda df: [dict(df.groupBy("shard").count().collect()).get(s, 0) for s in range(shards)]
    sizes = sizes_of(state)
    capacity = int(sum(sizes) / shards * (1 + slack)) + 1
    for r in range(rounds):
        linked = state.where("n_hub > 1")
        near = linked.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
        # A full shard can take nobody, so neighbours meet elsewhere; equal counts go by a hash, so that they agree.
        full = [s for s in range(shards) if sizes[s] >= capacity]
        goal = near.groupBy("hub").agg(
            F.max(F.struct((~F.col("shard").isin(full)).alias("open"), "n", F.xxhash64("hub", "shard").alias("tie"), F.col("shard").alias("to"))).alias("best"),
            F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("here"),
        )
        gain = F.col("best.n") - F.coalesce(F.col("here")[F.col("shard")], F.lit(0)) + 1
        level = F.least(F.lit(30), F.floor(F.log2(F.greatest(gain, F.lit(1)))) + 1).cast("int")
        goal = goal.where(F.size("here") > 1)
        asked = linked.join(goal, "hub").where(F.col("shard") != F.col("best.to"))
        want = {(x["shard"], x["to"], x["level"]): x["n"] for x in asked.select("shard", F.col("best.to").alias("to"), level.alias("level")).groupBy("shard", "to", "level").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not want:
            break
        quotas = _quotas(want, sizes, capacity)
        rows = [(i, j, least, share) for (i, j), (least, share) in quotas.items()]
        quota = state.sparkSession.createDataFrame(rows, "q_from int, q_to int, q_least int, q_share double")
        to = F.col("best.to")
        draw = F.pmod(F.xxhash64("key", F.lit(r)), F.lit(1 << 20)) / float(1 << 20)
        goes = (level >= F.col("q_least")) | ((level == F.col("q_least") - 1) & (draw < F.col("q_share")))
        moved = state.join(goal, "hub", "left").join(F.broadcast(quota), (F.col("shard") == F.col("q_from")) & (to == F.col("q_to")), "left")
        moved = moved.withColumn("shard", F.when((F.col("n_hub") > 1) & goes, to).otherwise(F.col("shard"))).select(*state.columns)
        state = table(moved, f"shards-{r}")
        sizes = sizes_of(state)
    return state


def even_rows(state: DataFrame, shards: int) -> DataFrame:
    """Shards whose counts differ by one at most, and gapless slots; rows leave full shards, unlinked ones first."""
    counts = dict(state.groupBy("shard").count().collect())
    sizes = [counts.get(s, 0) for s in range(shards)]
    n = sum(sizes)
    # The larger shards get the odd rows, so that fewer move.
    by_size = sorted(range(shards), key=lambda s: -sizes[s])
    quota = [n // shards] * shards
    for s in by_size[: n % shards]:
        quota[s] += 1
    over, gaps = 0, []
    before = []
    for s in range(shards):
        before.append(over)
        over += max(0, sizes[s] - quota[s])
    at = 0
    for s in range(shards):
        if (gap := quota[s] - sizes[s]) > 0:
            gaps.append((at, at + gap, s, sizes[s]))
            at += gap
    spread = F.pmod(F.xxhash64("key", "doc_id"), F.lit(256))
    bucket = F.when(F.col("n_hub") <= 1, 256 + spread).when(F.col("n_hub") > HOT_HUB, spread).otherwise(F.pmod(F.xxhash64("hub"), F.lit(256)))
    df = ranked(state, ["shard"], [F.col("hub"), F.col("doc_id"), F.col("key")], "rank", 512, bucket)
    pick = lambda values: F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("shard"))
    extra = F.col("rank") - pick(quota) + pick(before)
    shard: Column = F.lit(None).cast("int")
    slot: Column = F.lit(None).cast("long")
    for a, b, s, size in gaps:
        here = (extra >= a) & (extra < b)
        shard, slot = F.when(here, F.lit(s)).otherwise(shard), F.when(here, extra - a + size).otherwise(slot)
    stays = F.col("rank") < pick(quota)
    return df.withColumns({"slot": F.when(stays, F.col("rank")).otherwise(slot), "shard": F.when(stays, F.col("shard")).otherwise(shard)}).drop("rank")


def assign(docs: DataFrame, shards: int = 8, rounds: int = 8, slack: float = 0.02) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("hub"), F.xxhash64("doc_id", F.lit("row"), text).alias("key"),
    )
    rows = table(rows, "shard-rows")
    hubs = rows.groupBy("hub").agg(F.count(F.lit(1)).alias("n_hub")).where("n_hub > 1")
    state = rows.join(hubs, "hub", "left").withColumns({"n_hub": F.coalesce("n_hub", F.lit(1)), "shard": F.pmod("key", F.lit(shards)).cast("int")})
    state = propagate(table(state, "shard-start"), shards, rounds, slack)
    return even_rows(state, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
