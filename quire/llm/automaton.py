"""Minimal acyclic automata over a sorted set of byte strings, with perfect-hash numbers, as flat arrays.

The trie of the strings is laid out level by level; two nodes are one state where the same endings follow
them. Nodes are brought together by a hash of their endings, then every node is compared with the one that
stands for its state; if any differs, the trie itself serves, which gives the same answers. Each edge
carries how many strings come before those behind it, so the sum along a path is the string's number.
"""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Automaton:
    """rows: a matrix of bytes, one string to a row, padded with zeros, sorted and without repeats; zero is no letter."""

    def __init__(self, rows: np.ndarray, minimal: bool = True) -> None:
        n, width = rows.shape
        lengths = (rows != 0).sum(axis=1)
        common = np.full(n, -1)
        if n > 1:
            common[1:] = (rows[1:] != rows[:-1]).argmax(axis=1)
        starts, at = [], 0
        for d in range(width + 1):  # nodes of depth d: where a string parts from the one before it above d
            s = np.flatnonzero((common < d) & (lengths >= d))
            starts.append(s)
            if not len(s):
                break
        base = np.cumsum([0, *map(len, starts)])
        start = np.concatenate(starts)
        depth = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
        final = lengths[start] == depth
        parent = np.concatenate([np.zeros(0, dtype=np.int64), *[base[d - 1] + np.searchsorted(starts[d - 1], starts[d], "right") - 1 for d in range(1, len(starts))]]).astype(np.int64)
        child = np.arange(len(starts[0]), len(start))
        letter = rows[start[child], depth[child] - 1].astype(np.int64)
        first = np.searchsorted(parent, np.arange(len(start)), "left")
        many = np.searchsorted(parent, np.arange(len(start)), "right") - first
        state = np.arange(len(start))
        if minimal and n:
            state = self._merged(base, final, parent, letter, first, many, len(starts[0]))
        _, heads, self.state = np.unique(state, return_index=True, return_inverse=True)
        # Edges of the nodes that stand for their states, in order of (state, letter).
        counts = many[heads]
        self.n_edges, self.first_edge = counts, np.cumsum(counts) - counts
        edge = np.repeat(first[heads] - self.first_edge, counts) + np.arange(counts.sum())
        self.letter = letter[edge]
        self.target = self.state[child[edge]]
        self.before = start[child[edge]] - start[parent[edge]]
        self.key = np.repeat(np.arange(len(heads)), counts) * 256 + self.letter
        self.final = final[heads]
        self.root = int(self.state[0]) if n else -1
        self.n_nodes = len(start)

    @staticmethod
    def _merged(base, final, parent, letter, first, many, top) -> np.ndarray:
        """For each node the first node with the same endings."""
        sign = np.where(final, _ODD, np.uint64(1))
        for d in range(len(base) - 2, 0, -1):  # from the leaves up
            lo, hi = base[d], base[d + 1]
            if lo == hi:
                continue
            edges = slice(lo - top, hi - top)
            part = _mixed(sign[lo:hi] * np.uint64(257) + letter[edges].astype(np.uint64) + np.uint64(1))
            own, at = np.unique(parent[edges], return_index=True)
            sign[own] += np.add.reduceat(part, at)
        _, heads, inverse = np.unique(sign, return_index=True, return_inverse=True)
        head = heads[inverse]
        same = (final == final[head]).all() and (many == many[head]).all()
        if same:
            own = np.repeat(np.arange(len(many)), many)
            place = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
            other = first[head[own]] + place
            mine = first[own] + place
            same = (letter[mine] == letter[other]).all() and (head[mine + top] == head[other + top]).all()
        return head if same else np.arange(len(many))

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of states and letters the edges, and which of them exist."""
        key = state * 256 + letter
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, (self.key[at] == key) if len(self.key) else np.zeros(len(key), dtype=bool)

    def one_error(self, rows: np.ndarray, exact: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, number of a string): strings that part from a row by one replaced or one added letter after its first ``exact`` ones.

        rows: a matrix of strings of the automaton, all of the matrix's width; each pair comes once.
        """
        q, width = rows.shape
        if not q:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        state, number = np.full(q, self.root), np.zeros(q, dtype=np.int64)
        found = []
        for p in range(width + 1):
            if p >= exact:
                many = self.n_edges[state]
                who = np.repeat(np.arange(q), many)
                edge = np.repeat(self.first_edge[state] - (np.cumsum(many) - many), many) + np.arange(len(who))
                if p < width:  # an added letter equal to the next one is the same as one added after it
                    other = self.letter[edge] != rows[who, p]
                    who, edge = who[other], edge[other]
                    found.append((who, np.full(len(who), p + 1), self.target[edge], number[who] + self.before[edge]))
                found.append((who, np.full(len(who), p), self.target[edge], number[who] + self.before[edge]))
            if p < width:
                edge, _ = self.step(state, rows[:, p].astype(np.int64))
                state, number = self.target[edge], number + self.before[edge]
        who, place, state, number = (np.concatenate(x) for x in zip(*found, strict=True))
        out = []
        while len(who):
            over = place == width
            end = over & self.final[state]
            out.append((who[end], number[end]))
            who, place, state, number = (x[~over] for x in (who, place, state, number))
            edge, there = self.step(state, rows[who, place].astype(np.int64))
            edge = edge[there]
            who, place, state, number = who[there], place[there] + 1, self.target[edge], number[there] + self.before[edge]
        return (np.concatenate([w for w, _ in out]), np.concatenate([x for _, x in out])) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
