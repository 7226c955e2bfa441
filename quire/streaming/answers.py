"""Answers that come in chunks: chunk events of many requests folded by request, in a stream or in a batch.

A chunk event is (request string, no int, text string, last boolean, ts timestamp, input long, output long):
chunks of a request are numbered from 0, the last one says so and brings the counters of tokens. They may come
in any order, repeatedly, and some never; the first text of a number stays.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

ANSWER = "request string, answer string, n_chunks int, complete boolean, input long, output long"
#: parts: texts by number as JSON, one value however many chunks there are.
STATE = "parts string, n int, input long, output long, latest long, done boolean, due long"
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
ROW = Row(*(c.split(" ")[0] for c in ANSWER.split(", ")))
Held = tuple[dict[int, str], int, int | None, int | None, int, bool]


def held(state: Held | None, rows: Iterable[tuple]) -> Held:
    """The state with the chunks of some rows in it; n is how many there are to be, 0 as long as that isn't known."""
    parts, n, given, made, latest, done = state or ({}, 0, None, None, 0, False)
    for _, no, text, last, ts, read, wrote in rows:
        latest = max(latest, int(ts.timestamp() * 1000))
        if done:
            continue  # a chunk again, after the answer went out
        parts.setdefault(no, text or "")
        if last:
            n, given, made = no + 1, read, wrote
    return parts, n, given, made, latest, done


def whole(state: Held) -> bool:
    parts, n = state[:2]
    return n > 0 and len(parts) >= n and all(i in parts for i in range(n))


def answer(request: str, state: Held) -> tuple:
    """The row of a request, with as many chunks from the first one on as stand together."""
    parts = state[0]
    n = next(i for i in range(len(parts) + 1) if i not in parts)
    n = min(n, state[1]) if state[1] else n
    return request, "".join(parts[i] for i in range(n)), n, whole(state), state[2], state[3]


def _loaded(state: tuple) -> Held:
    return {int(no): text for no, text in json.loads(state[0]).items()}, *state[1:6]


class Answers(StatefulProcessor):
    """Holds the chunks of a request until its last missing one has come, or until it had no news for ``wait`` milliseconds of event time.

    A request has one timer. Where it goes off before the request is due, as there was news since, it is set anew.
    """

    def __init__(self, wait: int) -> None:
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        old = self.state.get()
        kept = held(_loaded(old) if old else None, rows)
        if not kept[5] and whole(kept):
            yield ROW(*answer(key[0], kept))
            kept = ({}, 0, None, None, kept[4], True)
        due = max(kept[4], timerValues.getCurrentWatermarkInMs()) + self.wait
        if not old:
            self.handle.registerTimer(due)
        self.state.update((json.dumps(kept[0]), *kept[1:], due))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        old = self.state.get()
        if old[6] > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(old[6])
            return
        kept = _loaded(old)
        self.state.clear()
        if not kept[5]:
            yield ROW(*answer(key[0], kept))

    def close(self) -> None:
        pass


def answers(chunks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of answers for a stream of chunks: each once, when its last missing chunk has come.

    A request without news for ``late`` of event time goes out as far as it has come, not complete, and is
    forgotten; so is the mark of an answer that went out, which till then holds repeated chunks off. The state
    is in RocksDB, which the session is set to.
    """
    wait = int(pd.Timedelta(late).total_seconds() * 1000)
    for k, v in STORE.items():
        chunks.sparkSession.conf.set(k, v)
    rows = chunks.select("request", "no", "text", "last", "ts", "input", "output")  # held() takes them by place
    return rows.withWatermark("ts", late).groupBy("request").transformWithState(Answers(wait), ANSWER, "append", "eventTime")


def folded(chunks: DataFrame) -> DataFrame:
    """The same answers for a table of chunks; of several texts of a number the smallest is taken."""
    once = chunks.groupBy("request", "no").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("last").alias("last"), F.max("input").alias("input"), F.max("output").alias("output"))
    rows = once.groupBy("request").agg(
        F.array_sort(F.collect_list(F.struct("no", "text"))).alias("parts"), F.max(F.when(F.col("last"), F.col("no") + 1)).alias("n"),
        F.max(F.when(F.col("last"), F.col("input"))).alias("input"), F.max(F.when(F.col("last"), F.col("output"))).alias("output"),
    )
    # In order and each number once, a part stands together with all before it if it has the number of its place.
    run = F.filter("parts", lambda p, i: (p["no"] == i) & (F.col("n").isNull() | (i < F.col("n"))))
    rows = rows.withColumn("run", run).withColumn("n_chunks", F.size("run"))
    said = F.array_join(F.transform("run", lambda p: p["text"]), "")
    return rows.select("request", said.alias("answer"), "n_chunks", F.coalesce(F.col("n_chunks") == F.col("n"), F.lit(False)).alias("complete"), "input", "output")
