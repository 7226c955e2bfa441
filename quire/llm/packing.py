"""Best-fit packing with swap-based local search, planned on the histogram of lengths.

Documents are tokenised and cut where they are written: only (doc_id, piece, length, checksum) rows
go on, never ids. Lengths are whole numbers up to the budget, so their histogram (``budget`` rows at
most, whatever the size of the corpus) is all that the plan needs. Whole counts of a length, in an
order that doesn't look at lengths, go by best fit into classes of equally filled bins; then a local
search moves documents or exchanges one for one, two for one and one for two between classes of
underfull bins while the sum of squared fills grows: until no two classes gain, or no fewer bins could
hold the total; a plan that is stuck is shaken and searched again (``plan``). The plan gives, for each length, ranges of ranks with their sequence and offset; a
piece finds its place by its rank among pieces of its length. Ranks come from counts by writing task,
joined by sort and merge as their number grows with the tasks, so no task holds all pieces of a
common length and nothing that grows with the corpus is broadcast.

Defined cases: null text is empty and packs as its closing id alone; null or repeated doc_ids are
packed row by row; texts of any length are cut into pieces and packed whole; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import common, tokens

Bin = tuple[int, ...]  # lengths, largest first

#: Shares of the bins that are filled anew where the search is stuck.
SHAKES = (1 / 8, 1)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def cut_pieces(path: str, budget: int, with_ids: bool):
    """Arrow batches of (doc_id, text) to pieces; the first piece of a long document takes the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).packed
        task = TaskContext.get().partitionId()
        seen = np.zeros(budget + 1, np.int64)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + b"\0\0\0\0"
                n = len(ids) // 4
                at = 0
                for k in range(-(-n // budget)):
                    length = (n - 1) % budget + 1 if k == 0 else budget
                    part = ids[4 * at : 4 * (at + length)]
                    for column, value in zip(out, (doc_id, k, at, length, zlib.crc32(part), task, int(seen[length]), part), strict=True):
                        column.append(value)
                    seen[length] += 1
                    at += length
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(out, kinds, strict=False)]
            names = [x.split()[0] for x in PIECES.split(", ")]
            if with_ids:
                flat = np.frombuffer(b"".join(out[7]), "<u4").astype(np.int32)
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in out[7]])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def arrival(counts: dict[int, int]) -> list[int]:
    """Lengths in an order that doesn't depend on their size, as documents come."""
    return sorted(counts, key=lambda n: (zlib.crc32(str(n).encode()), n))


def best_fit(counts: dict[int, int], budget: int, order: list[int] | None = None) -> dict[Bin, int]:
    """Best fit on whole counts, longest first or in the given order: bins by their lengths, with how many there are of each."""
    open_bins: dict[int, list[list]] = {}  # room -> [[how many, lengths]]
    rooms: list[int] = []
    full: dict[Bin, int] = {}

    def put(room: int, n: int, content: Bin) -> None:
        if not room:
            full[content] = full.get(content, 0) + n
            return
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append([n, content])

    for length in order if order is not None else sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                room, n, content = budget, left, ()
            else:
                room = rooms[i]
                n, content = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(i)
            k = room // length
            whole = min(n, left // k)
            if whole:
                put(room - k * length, whole, content + (length,) * k)
                left -= whole * k
            rest = n - whole
            if rest and 0 < left < k:
                put(room - left * length, 1, content + (length,) * left)
                left, rest = 0, rest - 1
            if rest and content:
                put(room, rest, content)
    for room in rooms:
        for n, content in open_bins[room]:
            full[content] = full.get(content, 0) + n
    return full


def _sums(content: Bin) -> tuple[list[int], list[int]]:
    """Sums of one length and of two lengths of a bin, each once, in order."""
    ones = sorted(set(content))
    twice = [x for x, y in zip(content, content[1:]) if x == y]
    return ones, sorted({x + y for i, x in enumerate(ones) for y in ones[:i]} | {2 * x for x in twice})


class _Sums:
    """What may leave a bin, and what may come back from it for one length and for two."""

    def __init__(self, content: Bin) -> None:
        self.fill = sum(content)
        self.ones, self.pairs = _sums(content)
        self.for_two = [0, *self.ones]
        self.for_one = sorted({*self.for_two, *self.pairs})


class _Log:
    """Classes in the order they came, with all that may come back from each; those that went have no room."""

    def __init__(self, budget: int) -> None:
        self.budget, self.n = budget, 0
        self.fill, self.bins = np.zeros(64, np.int64), []
        self.backs = [[np.zeros(64, np.int64), np.zeros(64, np.int64), [0]] for _ in range(2)]  # for one and for two: sums, numbers, ends

    def add(self, content: Bin, s: _Sums) -> int:
        if self.n == len(self.fill):
            self.fill = np.concatenate([self.fill, np.zeros_like(self.fill)])
        self.fill[self.n] = s.fill
        self.bins.append(content)
        for part, more in zip(self.backs, (s.for_one, s.for_two), strict=True):
            end = part[2][-1] + len(more)
            while end > len(part[0]):
                part[:2] = [np.concatenate([x, np.zeros_like(x)]) for x in part[:2]]
            part[0][end - len(more) : end] = more
            part[1][end - len(more) : end] = self.n
            part[2].append(end)
        self.n += 1
        return self.n - 1

    def best(self, a: _Sums, since: int, self_at: int) -> tuple[int, tuple[Bin, int, int, bool] | None]:
        """The best move from a to a class numbered from since on; self_at is a class to leave out."""
        gain, found = 0, None
        for (sums, number, ends), outs, two in zip(self.backs, (a.ones, a.pairs), (False, True), strict=True):
            y, k = sums[ends[since] : ends[-1]], number[ends[since] : ends[-1]]
            use = np.flatnonzero((self.fill[k] < self.budget) & (k != self_at))
            y, k = y[use], k[use]
            fill = self.fill[k]
            for x in outs:
                d = x - y
                at = np.flatnonzero((d > 0) & (d > a.fill - fill) & (d <= self.budget - fill))
                if len(at):
                    g = 2 * d[at] * (fill[at] - a.fill + d[at])
                    i = int(g.argmax())
                    if g[i] > gain:
                        gain, found = int(g[i]), (self.bins[k[at[i]]], x, int(y[at[i]]), two)
        return gain, found


def _pair(content: Bin, total: int) -> Bin:
    return next((x, total - x) for i, x in enumerate(content) if total - x in content[i + 1 :])


def _changed(content: Bin, out: Bin, into: Bin) -> Bin:
    rest = list(content)
    for x in out:
        rest.remove(x)
    return tuple(sorted(rest + list(into), reverse=True))


class _Fits:
    """Which exchanges fill a bin to the budget, by the sum that goes in: the most room first."""

    def __init__(self, budget: int) -> None:
        self.budget = budget
        self.of: tuple[dict[int, list], dict[int, list]] = ({}, {})  # for one and for two: sum in -> heap of (-room, sum back, number)

    def add(self, s: _Sums, number: int) -> None:
        room = self.budget - s.fill
        for found, backs in zip(self.of, (s.for_one, s.for_two), strict=True):
            for y in backs:
                if room + y < self.budget:
                    heapq.heappush(found.setdefault(room + y, []), (-room, y, number))

    def best(self, a: _Sums, log: _Log, without: int) -> tuple[Bin, int, int, bool] | None:
        """The exchange from a that fills the roomiest bin; ``without`` is a class to leave out."""
        most, best = 0, None
        for found, outs, two in zip(self.of, (a.ones, a.pairs), (False, True), strict=True):
            for x in outs:
                heap = found.get(x)
                aside = []
                while heap and (log.fill[heap[0][2]] >= self.budget or heap[0][2] == without):
                    top = heapq.heappop(heap)
                    if top[2] == without:
                        aside.append(top)
                if heap and -heap[0][0] > most:
                    fill = log.fill[heap[0][2]]
                    if fill - a.fill - heap[0][0] > 0:
                        most, best = -heap[0][0], (log.bins[heap[0][2]], x, heap[0][1], two)
                for top in aside:
                    heapq.heappush(heap, top)
        return best


def plan(counts: dict[int, int], budget: int, max_moves: int | None = None) -> dict[Bin, int]:
    """Bins by content: local search from best fit in order of arrival, and on from where it is stuck.

    A local optimum above the lower bound is shaken: its underfull bins, with a share of the others, those
    of the shortest documents first, are emptied and filled again by best fit, longest first, and the search
    goes on from there. The last share is all of them, so the plan is never worse than best fit decreasing.
    """
    bins = improve(_sorted(best_fit(counts, budget, arrival(counts))), budget, max_moves)
    floor = -(-sum(length * n for length, n in counts.items()) // budget)
    for share in SHAKES:
        if sum(bins.values()) <= floor:
            break
        other = improve(shaken(bins, budget, share), budget, max_moves)
        if sum(other.values()) < sum(bins.values()):
            bins = other
    return bins


def _sorted(bins: dict[Bin, int]) -> dict[Bin, int]:
    out: dict[Bin, int] = {}
    for content, n in bins.items():
        key = tuple(sorted(content, reverse=True))
        out[key] = out.get(key, 0) + n
    return out


def shaken(bins: dict[Bin, int], budget: int, share: float) -> dict[Bin, int]:
    """bins with all underfull ones, and a share of the whole, filled anew."""
    left = share * sum(bins.values())
    kept, loose = {}, {}
    for content, n in sorted(bins.items(), key=lambda x: (sum(x[0]) == budget, x[0][-1], x[0])):
        if sum(content) < budget or left > 0:
            left -= n
            for length in content:
                loose[length] = loose.get(length, 0) + n
        else:
            kept[content] = n
    for content, n in _sorted(best_fit(loose, budget)).items():
        kept[content] = kept.get(content, 0) + n
    return kept


def improve(bins: dict[Bin, int], budget: int, max_moves: int | None = None) -> dict[Bin, int]:
    """Empty underfull bins by moves and exchanges that raise the sum of squared fills.

    The emptiest class not yet done makes the exchange that fills the roomiest bin to the budget, if
    there is one, else the one of most gain with any class, for as many bins of both classes as there
    are. It stops where no fewer bins could hold the total, where no two classes gain, or after
    max_moves if the caller gives one. A class that is done looks again only at newer ones.
    """
    bins = dict(bins)
    total = sum(sum(c) * n for c, n in bins.items())
    count, floor = sum(bins.values()), -(-total // budget)
    log, fits = _Log(budget), _Fits(budget)
    sums: dict[Bin, _Sums] = {}
    born: dict[Bin, int] = {}
    seen: dict[Bin, int] = {}  # class -> how many classes there were when none of them gained
    todo: list[tuple[int, Bin]] = []

    def enter(c: Bin) -> None:
        if c in born:
            log.fill[born[c]] = budget
        sums[c] = _Sums(c)
        born[c] = log.add(c, sums[c])
        fits.add(sums[c], born[c])
        seen.pop(c, None)
        heapq.heappush(todo, (sums[c].fill, c))

    for c in sorted(bins):
        if sum(c) < budget:
            enter(c)
    moves = 0
    while count > floor and (max_moves is None or moves < max_moves):
        while todo and (todo[0][1] not in born or seen.get(todo[0][1]) == log.n):
            heapq.heappop(todo)
        if not todo:
            todo = sorted((sums[c].fill, c) for c in born if seen.get(c) != log.n)
            if not todo:
                break
        a = todo[0][1]
        # A bin of a class has itself as a partner if there are two of them.
        without = born[a] if bins[a] < 2 else -1
        best = fits.best(sums[a], log, without) or log.best(sums[a], seen.get(a, 0), without)[1]
        if best is None:
            seen[a] = log.n
            heapq.heappop(todo)
            continue
        b, x, y, two = best
        out = _pair(a, x) if two else (x,)
        back = () if not y else (y,) if y in b else _pair(b, y)
        m = bins[a] // 2 if a == b else min(bins[a], bins[b])
        for c in (a, b):
            bins[c] -= m
            if not bins[c]:
                log.fill[born.pop(c)] = budget
                del bins[c], sums[c]
                seen.pop(c, None)
        moves += 1
        for c in (_changed(a, out, back), _changed(b, back, out)):
            if not c:
                count -= m
                continue
            again = sum(c) < budget and bins.get(c, 0) < 2
            bins[c] = bins.get(c, 0) + m
            if again:
                enter(c)
    return bins


def slots(bins: dict[Bin, int]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: ranks from the first on take sequences in order."""
    rows, used, sequence = [], {}, 0
    for content, n in sorted(bins.items(), reverse=True):
        at = 0
        for length in content:
            rows.append((length, used.get(length, 0), sequence, at))
            used[length] = used.get(length, 0) + n
            at += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, budget: int = 2048, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) for every piece of docs (doc_id, text)."""
    spark = docs.sparkSession
    schema = PIECES + (", ids array<int>" if with_ids else "")
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut_pieces(path or tokens.tokenizer_path(), budget, with_ids), schema)
    pieces = common.table(cut, "pieces")
    by_task = common.table(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # budget rows at most
    places = spark.sparkContext.broadcast(slots(plan(counts, budget)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(starts.hint("merge"), ["task", "length"]).withColumn("rank", F.col("nth") + F.col("before")).drop("task", "nth", "before")

    def place(frames):
        table = places.value
        key = (table[:, 0] << 48) + table[:, 1]
        for f in frames:
            i = np.searchsorted(key, (f["length"].to_numpy() << 48) + f["rank"].to_numpy(), "right") - 1
            f["sequence_id"] = table[i, 2] + f["rank"].to_numpy() - table[i, 1]
            f["offset"] = table[i, 3]
            yield f[names]

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return ranked.mapInPandas(place, out)
