"""Groups over a stream of scored items: an extension, the batch operator's rule with state per key.

Items of a key must arrive in order. The open group is state; a group goes out when the next item
doesn't fit, and what is open when a key ends stays in the state until ``flush`` items (score null).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, group_no long, n_items long, score long"
STATE = "group_no long, n_items long, score long"


def fold(state: tuple[int, int, int], scores: list[Any], budget: int) -> tuple[tuple[int, int, int], list[tuple[int, int, int]]]:
    """(group_no, n_items, score) of the open group after the scores, and the groups that closed."""
    no, n, total = state
    done = []
    for s in scores:
        flush = s is None or s != s
        if total > 0 and (flush or total + s > budget):
            done.append((no, n, total))
            no, n, total = no + 1, 0, 0
        if not flush:
            n, total = n + 1, total + int(s)
    return (no, n, total), done


def budget_groups(items: DataFrame, budget: int) -> DataFrame:
    """items: a streaming frame (key string, seq long, score long)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        kept, done = fold(tuple(kept), rows["score"].tolist(), budget)
        state.update(kept)
        yield pd.DataFrame([(key[0], *d) for d in done], columns=["key", "group_no", "n_items", "score"])

    return items.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
