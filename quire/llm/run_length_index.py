"""A run-length index over a bounded set of byte strings.

The suffixes of the strings are sorted (each string ends in a symbol of its own, so that no match
crosses strings) and the Burrows-Wheeler transform is the symbol before each suffix. Only its runs
are kept: the symbol and first place of each, and at both ends a sample of the text position and of
the length that its suffix shares with the neighbour outside the run. Inside a run the neighbour of
the next position is the neighbour's next position, so the shared length falls by one a step; streaming
through the text from sample to sample gives the matching statistic of every position. The suffix
order lives only while the index is built. A string may stand for several equal ones: the runs of equal
strings are those of one, only longer, so it is indexed once and matches itself as a whole.
"""

from __future__ import annotations

import numpy as np

#: Symbols that the first sort looks at: nine bits each, so that a string's end sorts before all bytes.
FIRST = 7


class RunLengthIndex:
    def __init__(self, strings: list[bytes], several: list[bool] | None = None) -> None:
        lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.n = n = int(self.starts[-1])
        self.several = np.flatnonzero(several) if several is not None else []
        text = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8).astype(np.int64) + 1
        text[self.starts[1:] - 1] = 0
        left = np.repeat(self.starts[1:] - 1, lengths + 1) - np.arange(n)  # symbols up to the end of the string
        order = _sorted(text, left)
        before = text[order - 1]  # the first position of all comes after the end of the last string
        head = np.ones(n, bool)
        # A string's first position has no symbol before it in its string: each such is a run of its own.
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        heads, tails = np.flatnonzero(head), np.flatnonzero(np.append(head[1:], True))
        self.symbols, self.heads = before[heads].astype(np.int16), heads
        self.samples = [_samples(text, left, order, rows, step) for rows, step in ((heads, -1), (tails, 1))]

    @property
    def n_runs(self) -> int:
        return len(self.heads)

    @property
    def kept_bytes(self) -> int:
        """What the index holds: grows with the runs, not with the text."""
        return self.symbols.nbytes + self.heads.nbytes + sum(x.nbytes for pair in self.samples for x in pair)

    def matching(self) -> np.ndarray:
        """For each position the length of the longest match that starts there and somewhere else."""
        best = np.zeros(self.n, np.int64)
        place = np.arange(self.n)
        for at, length in self.samples:
            if len(at):
                last = np.searchsorted(at, place, "right") - 1
                np.maximum(best, np.where(last >= 0, length[last] - (place - at[last]), 0), out=best)
        for i in self.several:
            a, b = self.starts[i], self.starts[i + 1]
            best[a:b] = np.arange(b - a - 1, -1, -1)
        return best


def _sorted(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffix order by doubling; only suffixes that still share their rank are sorted again. Equal ones stay in text order."""
    n = len(text)
    key = np.zeros(n, np.int64)
    for k in range(min(FIRST, n)):
        key[: n - k] |= np.where(left[: n - k] >= k, text[k:], 0) << (9 * (FIRST - 1 - k))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    width = FIRST
    rank = np.empty(n, np.int64)
    while True:
        # Those that end within the width are the same up to their ends: the order of the text decides.
        new |= left[order] < width
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        single = new & np.append(new[1:], True)
        live = np.flatnonzero(~single)
        if not len(live):
            return order
        at = order[live]
        key = rank[at] * (n + 1) + rank[at + width]
        by = np.argsort(key, kind="stable")
        order[live] = at[by]
        ordered = key[by]
        new[live[1:]] = ordered[1:] != ordered[:-1]
        new[live[0]] = True
        width *= 2


def _samples(text: np.ndarray, left: np.ndarray, order: np.ndarray, rows: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the suffixes at rows, in order of the text, and what each shares with the one step away."""
    rows = rows[(rows + step >= 0) & (rows + step < len(order))]
    a, b = order[rows], order[rows + step]
    by_place = np.argsort(a)
    a, b = a[by_place], b[by_place]
    most = np.minimum(left[a], left[b])
    words = np.zeros(len(text), np.uint64)
    for k in range(min(8, len(text))):
        words[: len(text) - k] |= (text[k:] & 255).astype(np.uint64) << np.uint64(8 * k)
    length = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        x = words[a[live] + length[live]] ^ words[b[live] + length[live]]
        # Equal bytes before the first other one; a word never says more than what is left of both strings.
        low = x & (~x + np.uint64(1))
        equal = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        length[live] = np.minimum(length[live] + equal, most[live])
        live = live[(equal == 8) & (length[live] < most[live])]
    return a, length
