"""N-gram Jaccard join by universe partition and the pigeonhole principle, exact.

A document's set holds 64-bit fingerprints of its distinct five-word shingles. Texts with the same set
form a class. For each band of set sizes the universe of fingerprints is cut by hash into segments. Two
sets of sizes n and m link only if they differ in (n + m) // 9 elements at most, so if a set brings
segments whose allowances sum to one more than that, one of them agrees in the other set within its
allowance: 1 for a segment indexed as it is, 2 for one indexed with its one-deletion neighbourhood.
The allocation of a band is chosen by cost: rows to shuffle and candidates to expect (see ``Plan``).

Signatures that occur once drop out in a count by hash. Signatures of few sets give candidates within
their group, which must also share as many segments as the bound demands. Signatures of many sets
(``CAP``) are left aside as long as a set has enough others; the sets that haven't (large groups of near
copies) choose their least frequent crowded ones. For them the universe is parted once more: fingerprints
that many of these sets have make one segment that is not indexed, each other one is a segment of its own.
Pairs that share one of the latter are candidates; with fingerprints in one order, those of one set alone first and common ones last,
linked sets share one within the first fifth of each and one more, so no others are looked at. All other pairs have common fingerprints in common only,
so few that most can't link by their numbers, and all else that a set has is a difference, so that it asks by fewer segments; those
that can link are held first against two group leaders (that
with the largest common part, and another by hash), then against more leaders that they aren't connected with, then a few sets of each
component against a few of any other that shares a signature, and what is apart after that whole. A set that has enough
outside of crowded signatures itself isn't asked: its pairs are found without. Every candidate is verified on the whole sets.

Set sizes and links rest on fingerprints of 64 bits, classes on 128. Defined cases: null texts and texts
without words have an empty set and link with nothing; fewer words than the width make one shingle; a
null doc_id takes part and yields to any other as component_id; repeated rows are one class; an empty
table gives no rows; other columns are ignored; texts of any length bring all their shingles; a tie in
similarity at the bound links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import dropped, marked, sliced, table

CAP = 16
#: Leaders of a crowded signature: so many by their common part, and as many by hash.
LEADERS = 8
#: Sets of each component that are held first, for each crowded signature.
FEW = 4
#: Times that this is done, each by two other signatures of each set, as long as it links any.
ROUNDS = 3
MAP_BITS = 1 << 26
#: Least set size for which segments without deletions are safe to have enough that aren't empty.
LARGE = 100
#: Parts of a sketch, which rules pairs out before their sets are brought together.
SKETCH = 128
U = np.uint64


# -- sets ------------------------------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_rng = np.random.default_rng(20240518)
#: A number for each byte; white space has none.
BYTE_HASH = _rng.integers(1, 1 << 63, 256, np.uint64) * U(2) + U(1)
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
BYTE_HASH[SPACE] = 0
PIECE = 1 << 18


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    up = np.multiply.accumulate(np.concatenate([[U(1)], np.full(n, U(base))]))
    down = np.multiply.accumulate(np.concatenate([[U(1)], np.full(n, U(pow(base, -1, 1 << 64)))]))
    return up, down


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words between white space, in order, and where they start: polynomials over bytes."""
    found, places, at = [], [], 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            # Pieces end at white space; a longer word is a piece of its own length.
            while end < len(raw) and not SPACE[raw[end]]:
                end += 1
        b = np.frombuffer(raw, np.uint8, min(end, len(raw)) - at, at)
        size = 1 << max(12, len(b).bit_length())
        up, down = _powers(max(size, PIECE * 2))
        blank = SPACE[b]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        edge = np.concatenate([[0], edge, [len(b)]]) if not blank[0] else np.concatenate([edge, [len(b)]])
        starts, stops = edge[: len(edge) // 2 * 2 : 2], edge[1::2]
        if len(starts):
            sums = np.concatenate([[U(0)], np.cumsum(BYTE_HASH[b] * up[: len(b)])])
            found.append(mixed((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(U)))
            places.append(starts + at)
        at = end
    return (np.concatenate(found), np.concatenate(places)) if found else (np.zeros(0, U), np.zeros(0, np.int64))


def _shingles(w: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mixed hashes of the n runs of ``width`` words that start at the first n words."""
    h = np.full(n, width, U)
    for k in range(width):
        h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9) + w[k : k + n]
    return mixed(h)


def fingerprints(raw: bytes, width: int) -> np.ndarray:
    """Sorted distinct fingerprints of the shingles of a text's bytes."""
    w, _ = word_hashes(raw.lower())
    return np.unique(_shingles(w, min(width, len(w)), max(1, len(w) - width + 1))) if len(w) else w


def all_fingerprints(raws: list[bytes], width: int) -> Iterator[np.ndarray]:
    """fingerprints() of each text; short texts are hashed together."""
    i = 0
    while i < len(raws):
        end, total = i, 0
        while end < len(raws) and (end == i or total + len(raws[end]) < PIECE):
            total += len(raws[end]) + 1
            end += 1
        group = raws[i:end]
        i = end
        w, places = word_hashes(b"\n".join(group).lower())
        ends = np.cumsum([len(r) + 1 for r in group])
        last = np.searchsorted(places, ends)
        first = np.concatenate([[0], last[:-1]])
        h = _shingles(w, width, len(w) - width + 1) if len(w) >= width else None
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a >= width:
                yield np.unique(h[a : b - width + 1])
            else:
                yield np.unique(_shingles(w[a:b], b - a, 1)) if b > a else np.zeros(0, U)


def class_of(prints: np.ndarray) -> tuple[int, int]:
    """128 bits of the set as two signed numbers."""
    d = xxhash.xxh3_128_digest(prints.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


# -- bands and their plans -------------------------------------------------------------------------


@dataclass(frozen=True)
class Plan:
    """How the sets of sizes lo to hi are indexed: segments, and whether with one-deletion neighbourhoods."""

    band: int
    lo: int
    hi: int
    segments: int
    deletions: bool


def differing(n: int, m: int) -> int:
    """The most elements in which linked sets of these sizes differ."""
    return (n + m) // 9


def allocate(band: int, lo: int, hi: int, per_segment: float | None = None) -> Plan:
    """The cheaper of both allocations: rows per set, and candidates as falls with the elements in a segment."""
    worst = differing(hi * 5 // 4, hi)
    pairs = worst // 2 + 1
    options = [((pairs + hi) * (1 + 10 * 0.5 ** (lo / pairs)), Plan(band, lo, hi, pairs, True))]
    if lo >= LARGE:
        # A quarter of hi and one more are needed at most; the rest is room for empty ones.
        u = per_segment or (3.0 if hi < 300 else 3.5 if hi < 1000 else 3.8)
        m = int(hi / u)
        options.append((m * (1 + 10 * 0.5**u), Plan(band, lo, hi, m, False)))
    return min(options, key=lambda x: x[0])[1]


@lru_cache(maxsize=4096)
def plan_of(band: int) -> Plan:
    lo = 1
    for _ in range(band):
        lo = max(lo + 1, lo * 3 // 2)
    return allocate(band, lo, max(lo + 1, lo * 3 // 2) - 1)


def band_of(n: int) -> int:
    band = 0
    while plan_of(band).hi < n:
        band += 1
    return band


def placed(prints: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the fingerprints in a band, and the segment of each."""
    h = mixed(prints ^ U(plan.band * 0x51ED27 + 1))
    return h, ((h >> U(32)) % U(plan.segments)).astype(np.int64)


def signatures(prints: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, int]:
    """Signatures, the segment of each, and the sum of allowances they stand for."""
    h, segment = placed(prints, plan)
    # Sixteen bits sort in linear time.
    order = np.argsort(segment.astype(np.uint16) if plan.segments <= 1 << 16 else segment, kind="stable")
    segment, values = segment[order], mixed(h[order])
    heads = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    sums, own = np.add.reduceat(values, heads), segment[heads]
    salt = lambda s: mixed((s.astype(U) + U(1)) * U(0x9E3779B97F4A7C15) + U(plan.band))
    exact = mixed(sums ^ salt(own))
    if not plan.deletions:
        return exact, own, len(own)
    each = np.repeat(sums, np.diff(np.append(heads, len(values)))) - values
    empty = np.setdiff1d(np.arange(plan.segments), own)
    found = [exact, mixed(each ^ salt(segment)), mixed(salt(empty))]
    return np.concatenate(found), np.concatenate([own, segment, empty]), 2 * plan.segments


def whole_of(sigs: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """For each of a band's signatures, as signatures() gives them, that of its segment without a deletion.

    Two sets with the same segment share all its signatures; by these, this one is enough to bring them together.
    """
    # It comes before the segment's others.
    _, first, of = np.unique(segments, return_index=True, return_inverse=True)
    return sigs[first][of]


def entries(prints: np.ndarray) -> Iterator[tuple[Plan, np.ndarray, np.ndarray, int, int]]:
    """Per band that a set is indexed or searched in: signatures, segments, allowances, allowances needed.

    The larger set of a pair searches, so a set goes into its own band and those of smaller partners.
    """
    n = len(prints)
    band = band_of(n)
    while band >= 0 and plan_of(band).hi * 5 >= n * 4:
        plan = plan_of(band)
        sigs, segments, have = signatures(prints, plan)
        yield plan, sigs, segments, have, differing(n, min(n, plan.hi)) + 1
        band -= 1


# -- scans over documents --------------------------------------------------------------------------


def _raw(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


def _sizes(width: int):
    kinds = [("doc_id", pa.int64()), ("row", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for doc_id, prints, row in zip(batch.column(0).to_pylist(), all_fingerprints(_raw(batch.column(1)), width), batch.column(2).to_pylist(), strict=True):
                rows.append((doc_id, row, *class_of(prints), len(prints)))
            yield _batch(rows, kinds)

    return run


def _distinct_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """The non-empty sets of the texts, each class once per batch."""
    for batch in sliced(batches):
        seen = set()
        for prints in all_fingerprints(_raw(batch.column(0)), width):
            key = class_of(prints)
            if len(prints) and key not in seen:
                seen.add(key)
                yield *key, prints


def _signature_counts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for _, _, prints in _distinct_sets(batches, width):
            for _, sigs, _, _, _ in entries(prints):
                held.append(np.unique(sigs))
                total += len(sigs)
            if total > 300_000:
                yield _counted(held)
                held, total = [], 0
        if held:
            yield _counted(held)

    def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
        sigs, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(n.astype(np.int32))], ["sig", "n"])

    return run


def _in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys % U(len(bits) * 8)
    return (bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1


#: Crowded signatures by how many sets have them: twice the cap and more, four times, and so on, as far as it matters for a choice.
LEVELS = 14
LEVEL_BITS = 1 << 21
CROWD = "c: long, n: int, own: boolean, asks: array<long>, largest: long, hot: array<long>, wholes: array<long>"


def _least_frequent(sigs: np.ndarray, segments: np.ndarray, worth: np.ndarray, lack: int, levels) -> np.ndarray:
    """Which signatures make up the least frequent segments that are worth ``lack`` together; worth: of each signature's segment."""
    level = sum(_in_map(m, sigs).astype(np.int64) for m in levels.value)
    heads, at, inverse = np.unique(segments, return_index=True, return_inverse=True)
    size, worth = np.bincount(inverse, 2.0**level, len(heads)), worth[at]
    cost = np.divide(size, worth, out=np.full(len(heads), np.inf), where=worth > 0)
    order = np.lexsort((heads, cost))
    chosen = np.zeros(len(heads), bool)
    chosen[order[: np.searchsorted(np.cumsum(worth[order]), lack) + 1]] = True
    return chosen[inverse]


def asks_by_common(prints: np.ndarray, often: np.ndarray, several: np.ndarray, hot: np.ndarray, levels) -> np.ndarray:
    return asks_with_wholes(prints, often, several, hot, levels)[0]


def asks_with_wholes(prints: np.ndarray, often: np.ndarray, several: np.ndarray, hot: np.ndarray, levels) -> tuple[np.ndarray, np.ndarray]:
    """The crowded signatures by which a set must ask for sets that share none but its common fingerprints (``often``, a mask).

    All its others are differences then. A segment stands for its allowance less the differences that lie in
    it, so that fewer of the segments chosen by ``_crowd_row`` make up for the differences that are left.
    The second array has whole_of() each.
    """
    found, wholes = [np.zeros(0, U)], [np.zeros(0, U)]
    for plan, sigs, segments, have, need in entries(prints):
        full = _in_map(several, sigs) & _in_map(hot, sigs)
        crowded, allow = np.unique(segments[full]), 2 if plan.deletions else 1
        if (lack := need - have + allow * len(crowded)) <= 0:
            continue
        left = np.maximum(allow - np.bincount(placed(prints[~often], plan)[1], minlength=plan.segments), 0)
        others = np.setdiff1d(np.arange(plan.segments) if plan.deletions else segments, crowded)
        whole = whole_of(sigs, segments)[full]
        sigs, segments = sigs[full], segments[full]
        take = _least_frequent(sigs, segments, np.full(len(sigs), allow), lack, levels)
        if (lack := need - int((~often).sum()) - int(left[others].sum())) > 0:
            sigs, segments, whole = sigs[take], segments[take], whole[take]
            last = _least_frequent(sigs, segments, left[segments], lack, levels)
            found.append(sigs[last])
            wholes.append(whole[last])
    sigs, at = np.unique(np.concatenate(found), return_index=True)
    return sigs, np.concatenate(wholes)[at]


def lacking(n: int, spare: int) -> bool:
    """Whether a set of n needs to be asked by its crowded signatures: its other allowances aren't enough with its largest partner."""
    return spare <= differing(n * 5 // 4, n)


def _crowd_row(h1: int, n: int, plan: Plan, own: bool, sigs: np.ndarray, segments: np.ndarray, wholes: np.ndarray, spare: int, need: int, levels) -> tuple:
    """What a set asks and offers in a band by its crowded signatures.

    asks: those of its least frequent crowded segments, as many as make up for the allowances that it
    lacks outside of them; largest: the most frequent of these; hot: all of them, where others may ask, wholes: whole_of() each.
    spare: the allowances outside of crowded segments. Others needn't ask a set for which these are enough
    with its largest partner: one of those segments agrees, so the pair is found by a signature of few sets.
    """
    lack = need - spare
    own = own and lacking(n, spare)
    asks, largest = np.zeros(0, U), None
    if lack > 0:
        asks = sigs[_least_frequent(sigs, segments, np.full(len(sigs), 2 if plan.deletions else 1), lack, levels)]
        level = sum(_in_map(m, asks).astype(np.int64) for m in levels.value)
        largest = int(asks[np.lexsort((asks, -level))[0]].view(np.int64))
    hot, at = np.unique(sigs[:None if own else 0], return_index=True)
    return h1, n, own, np.unique(asks).view(np.int64), largest, hot.view(np.int64), wholes[at].view(np.int64)


def _signature_rows(width: int, often, hot, levels):
    """Per set and band: a row for each signature that few sets have, and one row for all crowded ones."""
    names = ["sig", "c", "n", "band", "seg", "allow", "have", "own"]
    kinds = [np.int64, np.int64, np.int32, np.int32, np.int32, np.int32, np.int32, np.bool_]
    crowd = [("c", pa.int64()), ("n", pa.int32()), ("own", pa.bool_()), ("asks", pa.list_(pa.int64())), ("largest", pa.int64()), ("hot", pa.list_(pa.int64())), ("wholes", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        crowded: list[tuple] = []
        total = 0
        for h1, _, prints in _distinct_sets(batches, width):
            n, own = len(prints), band_of(len(prints))
            for plan, sigs, segments, have, need in entries(prints):
                keep = _in_map(often.value, sigs)
                every = sigs, segments
                sigs, segments = sigs[keep], segments[keep]
                full = _in_map(hot.value, sigs)
                if full.any():
                    allow = 2 if plan.deletions else 1
                    gone = allow * len(np.unique(segments[full]))
                    offers = plan.band == own and lacking(n, have - gone)
                    wholes = whole_of(*every)[keep][full] if offers else sigs[:0]
                    row = _crowd_row(h1, n, plan, offers, sigs[full], segments[full], wholes, have - gone, need, levels)
                    if len(row[3]) or len(row[5]):
                        crowded.append(row)
                    have -= gone
                    sigs, segments = sigs[~full], segments[~full]
                if len(sigs):
                    held.append((sigs.view(np.int64), segments, (h1, n, plan.band, 2 if plan.deletions else 1, have, plan.band == own)))
                total += len(sigs) + 50 * bool(full.any())
            if total > 60_000:
                yield from joined(held, crowded)
                held, crowded, total = [], [], 0
        yield from joined(held, crowded)

    def joined(held: list[tuple], crowded: list[tuple]) -> Iterator[pa.RecordBatch]:
        if held:
            times = [len(s) for s, _, _ in held]
            one = [np.repeat(np.array(c, k), times) for c, k in zip(zip(*(f for _, _, f in held), strict=True), (kinds[i] for i in (1, 2, 3, 5, 6, 7)), strict=True)]
            columns = [np.concatenate([s for s, _, _ in held]), *one[:3], np.concatenate([g for _, g, _ in held]).astype(np.int32), *one[3:]]
            rows = len(columns[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.nulls(rows, pa.struct(crowd))], [*names, "crowd"])
        if crowded:
            nulls = [pa.nulls(len(crowded), pa.from_numpy_dtype(k)) for k in kinds]
            parts = [pa.array(list(c), t) for c, (_, t) in zip(zip(*crowded, strict=True), crowd, strict=True)]
            yield pa.RecordBatch.from_arrays([*nulls, pa.StructArray.from_arrays(parts, [k for k, _ in crowd])], [*names, "crowd"])

    return run


def _asked(batches: Iterator[pa.RecordBatch], asked) -> Iterator[pa.RecordBatch]:
    """Sets (y, yn, hot, wholes) with those of their crowded signatures that any set asks for."""
    for batch in sliced(batches):
        rows = []
        for y, yn, hot, wholes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sigs = np.array(hot, np.int64)
            take = _in_map(asked.value, sigs.view(U))
            if take.any():
                rows.append((y, yn, sigs[take], np.array(wholes, np.int64)[take]))
        yield _batch(rows, [("y", pa.int64()), ("yn", pa.int32()), ("sig", pa.list_(pa.int64())), ("whole", pa.list_(pa.int64()))])


def sketch_of(prints: np.ndarray) -> bytes:
    """How many fingerprints fall into each of SKETCH parts; empty if a part has more than 16 bits can count."""
    counts = np.bincount((prints >> U(40)).astype(np.int64) % SKETCH, minlength=SKETCH)
    return counts.astype(np.uint16).tobytes() if counts.max() < 1 << 16 else b""


def _able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a1, a2, b1, b2, sa, sb) whose sketches allow a link: sets share no more in a part than the lesser has there."""
    for batch in sliced(batches, 4000):
        a, b = ([np.frombuffer(x, np.uint16) for x in batch.column(i).to_pylist()] for i in (4, 5))
        known = np.array([len(x) > 0 and len(y) > 0 for x, y in zip(a, b, strict=True)], bool)
        keep = ~known
        if known.any():
            x, y = (np.stack([v for v, k in zip(c, known, strict=True) if k]).astype(np.int64) for c in (a, b))
            keep[known] = 9 * np.minimum(x, y).sum(axis=1) >= 4 * (x.sum(axis=1) + y.sum(axis=1))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:4]], ["a1", "a2", "b1", "b2"])


def _wanted_sets(width: int, wanted):
    kinds = [("h1", pa.int64()), ("h2", pa.int64()), ("sketch", pa.binary()), ("prints", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for h1, h2, prints in _distinct_sets(batches, width):
            if _in_map(wanted.value, np.array([h1], np.int64).view(U))[0]:
                rows.append((h1, h2, sketch_of(prints), prints.tobytes()))
                if len(rows) == 256:
                    yield _batch(rows, kinds)
                    rows = []
        if rows:
            yield _batch(rows, kinds)

    return run


def _element_counts(crowd):
    """Sums per batch of how many of the crowd's sets have a fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            inside = _in_map(crowd.value, batch.column(0).to_numpy().view(U))
            held = [np.frombuffer(p, U) for p in batch.column(1).filter(pa.array(inside)).to_pylist()]
            if held:
                prints, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(n)], ["e", "n"])

    return run


def first_rare(prints: np.ndarray, often: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The fingerprints that are neither common (``often``) nor the set's alone, as far as linked sets that share any share one of them.

    In an order of all, those of one set alone first, common ones last, the first that two linked sets share has
    no more before it in either than a set may lack, a fifth. So each brings what is left of its fifth and one more.
    """
    n, alone = len(prints), int((~often & ~shared).sum())
    return prints[~often & shared][: max(0, n - -(-4 * n // 5) + 1 - alone)]


def _parts(crowd, asking, common, several, often, hot, levels):
    """Per set of the crowd how many of its fingerprints are common, the rare ones to share, and the signatures to ask by."""
    kinds = [("c", pa.int64()), ("common", pa.int32()), ("e", pa.list_(pa.int64())), ("sig", pa.list_(pa.int64())), ("whole", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            inside = _in_map(crowd.value, batch.column(0).to_numpy().view(U))
            for h1, raw, take in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), inside.tolist(), strict=True):
                if take:
                    prints = np.frombuffer(raw, U)
                    held = _in_map(common.value, prints)
                    asks = wholes = np.zeros(0, U)
                    if 5 * held.sum() >= 4 * len(prints) and _in_map(asking.value, np.array([h1], np.int64).view(U))[0]:
                        asks, wholes = asks_with_wholes(prints, held, often.value, hot.value, levels)
                    rare = first_rare(prints, held, _in_map(several.value, prints))
                    rows.append((h1, int(held.sum()), rare.view(np.int64), asks.view(np.int64), wholes.view(np.int64)))
            yield _batch(rows, kinds)

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        a, b = ([np.frombuffer(x, U) for x in batch.column(i).to_pylist()] for i in (4, 5))
        keep = pa.array([linked(x, y) for x, y in zip(a, b, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:4]], ["a1", "a2", "b1", "b2"])


# -- the join --------------------------------------------------------------------------------------


def bit_map(df: DataFrame, column: str, bits: int = MAP_BITS):
    """A broadcast map of so many bits, whatever the number of rows: the bits of the column's values."""
    # bits is a power of two, so the remainder is that of the unsigned number; bitmaps count from 1.
    at = F.pmod(F.col(column), F.lit(bits)) + 1
    found = df.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for r in found.collect():  # blocks of 4 KiB, as many as the map has at most
        part = np.frombuffer(bytes(r["m"]), np.uint8)
        begin = (r["b"] - 1) * 4096
        out[begin : begin + len(part)] = part[: len(out) - begin]
    return df.sparkSession.sparkContext.broadcast(out)


def level_maps(counts: DataFrame, cap: int):
    """A broadcast map for each level: bits of the signatures that cap, doubled so often, or more sets have."""
    at = F.pmod("sig", F.lit(LEVEL_BITS)) + 1
    top = F.least(F.lit(LEVELS), F.floor(F.log2(F.col("n") / F.lit(cap))).cast("int"))
    rows = counts.where(F.col("n") >= 2 * cap).select(F.explode(F.sequence(F.lit(1), top)).alias("level"), at.alias("at"))
    found = rows.groupBy("level", F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m"))
    out = [np.zeros(LEVEL_BITS // 8, np.uint8) for _ in range(LEVELS)]
    for r in found.collect():  # blocks of 4 KiB, as many as the map has at most
        part = np.frombuffer(bytes(r["m"]), np.uint8)
        begin = (r["b"] - 1) * 4096
        own = out[r["level"] - 1]
        own[begin : begin + len(part)] = part[: len(own) - begin]
    return counts.sparkSession.sparkContext.broadcast(out)


def sets_of(classes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """h1, h2, sketch, prints of all classes whose first half is among classes (h1), and of few others."""
    wanted = bit_map(classes, "h1", 1 << 24)
    sets = texts.mapInArrow(_wanted_sets(width, wanted), "h1 long, h2 long, sketch binary, prints binary")
    return table(sets.groupBy("h1", "h2").agg(F.first("sketch").alias("sketch"), F.first("prints").alias("prints")), "jaccard-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a1, a2, b1, b2) between classes among candidate pairs (x, y) of first halves of classes."""
    a, b = (lambda what, p=p: sets.select(F.col("h1").alias(f"{p}1"), F.col("h2").alias(f"{p}2"), F.col(what).alias(f"{what[0]}{p}")) for p in "ab")
    able = pairs.join(a("sketch"), F.col("x") == F.col("a1")).join(b("sketch"), F.col("y") == F.col("b1")).select("a1", "a2", "b1", "b2", "sa", "sb")
    able = table(able.mapInArrow(_able, "a1 long, a2 long, b1 long, b2 long"), "jaccard-able")
    # Only the sets of these pairs go into the joins' shuffles.
    sets = marked(sets, able.select(F.col("a1").alias("h1")).union(able.select("b1")), ["h1"]).where("_maybe")
    full = able.join(a("prints"), ["a1", "a2"]).join(b("prints"), ["b1", "b2"]).select("a1", "a2", "b1", "b2", "pa", "pb")
    links = table(full.mapInArrow(_verify, "a1 long, a2 long, b1 long, b2 long"), "jaccard-links")
    dropped(able)
    return links


def components(links: DataFrame) -> DataFrame:
    """h1, h2, root: the least class of each class's component; classes without links aren't listed.

    Large and small stars in turn. Each edge is one row, from the greater class u to the lesser v, and no
    step makes more rows than there are edges, so a group's joins grow with its links and not with their square.
    """
    a, b = (F.struct(F.col(f"{p}1").alias("h1"), F.col(f"{p}2").alias("h2")) for p in "ab")
    edges = table(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc-edges")
    while True:
        # Large star: what is greater than v goes to the least that v has; small star: what u has goes to the least of it.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        large = edges.join(least.toDF("v", "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        large = table(large.distinct(), "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        others = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = table(others.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
        dropped(edges, large)
        # Stars alone are left once nobody has two lesser classes and no centre has one.
        several = small.groupBy("u").agg((F.min("v") < F.max("v")).alias("two")).where("two").select("u")
        if several.unionByName(small.select("u").join(small.select(F.col("v").alias("u")), "u", "left_semi")).isEmpty():
            roots = small.select("v").distinct()
            both = small.unionByName(roots.select(F.col("v").alias("u"), "v"))
            return both.select("u.h1", "u.h2", F.col("v").alias("root"))
        edges = small


def near_links(texts: DataFrame, width: int, cap: int = CAP) -> DataFrame:
    """Edges between classes that connect all that exact comparison would connect, and no others. texts: one column text."""
    counts = texts.mapInArrow(_signature_counts(width), "sig long, n int").groupBy("sig").agg(F.sum("n").alias("n"))
    counts = table(counts.where("n > 1"), "jaccard-signatures")
    often, hot = bit_map(counts, "sig"), bit_map(counts.where(F.col("n") > cap), "sig", 1 << 25)
    levels = level_maps(counts, cap)
    rows = texts.mapInArrow(_signature_rows(width, often, hot, levels), f"sig long, c long, n int, band int, seg int, allow int, have int, own boolean, crowd struct<{CROWD}>")
    rows = table(rows, "jaccard-rows")
    cold = rows.where("crowd is null")
    left, right = (cold.select("sig", *[F.col(k).alias(f"{p}{k}") for k in ("c", "n", "band", "seg", "allow", "have", "own")]) for p in ("x", "y"))
    fits = "yown and xc <> yc and (xn > yn or (xn = yn and xc > yc)) and yn * 5 >= xn * 4 and xband = yband"
    near = left.join(right, "sig").where(fits).groupBy("xc", "yc", "xband").agg(F.count_distinct("xseg").alias("shared"), F.first("xhave").alias("have"), F.first("xallow").alias("allow"), F.first("xn").alias("n"), F.first("yn").alias("m"))
    near = near.where("allow = 2 or shared >= have - floor((n + m) / 9)").select(F.col("xc").alias("x"), F.col("yc").alias("y")).distinct()
    near = table(near, "jaccard-pairs")
    # Sets that lack allowances outside crowded signatures ask by their least frequent crowded segments; each set is one row.
    crowd_rows = rows.where("crowd is not null").select("crowd.*")
    asks = crowd_rows.where("size(asks) > 0").groupBy(F.col("c").alias("x"), F.col("n").alias("xn")).agg(F.array_distinct(F.flatten(F.collect_list("asks"))).alias("sigs"), F.min("largest").alias("largest"))
    asks = table(asks, "jaccard-asks")
    asked = bit_map(asks.select(F.explode("sigs").alias("sig")), "sig", 1 << 24)
    members = crowd_rows.where("own and size(hot) > 0").select(F.col("c").alias("y"), F.col("n").alias("yn"), "hot", "wholes").mapInArrow(lambda b: _asked(b, asked), "y long, yn int, sig array<long>, whole array<long>")
    members = table(members.groupBy("y", "yn").agg(F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("sig", "whole")))).alias("sigs")), "jaccard-members")
    dropped(rows, counts)
    named = [near.select("x"), near.select("y"), asks.select("x"), members.select("y")]
    classes = named[0].toDF("h1")
    for c in named[1:]:
        classes = classes.union(c.toDF("h1"))
    sets = sets_of(classes, texts, width)
    links = verified(near, sets)
    if asks.isEmpty():
        return links
    # One universe for all sets in question: their common fingerprints, and the others one by one. The maps
    # err towards common only, so a fingerprint outside of them is in ``cap`` sets at most.
    crowd = bit_map(asks.select(F.col("x").alias("h1")).union(members.select("y")), "h1", 1 << 24)
    elements = sets.select("h1", "prints").mapInArrow(_element_counts(crowd), "e long, n long").groupBy("e").agg(F.sum("n").alias("n"))
    elements = table(elements.where("n > 1"), "jaccard-elements")
    common, several = bit_map(elements.where(F.col("n") > cap), "e"), bit_map(elements.where(F.col("n") <= cap), "e")
    asking = bit_map(asks.select("x"), "x", 1 << 24)
    parts = sets.select("h1", "prints").mapInArrow(_parts(crowd, asking, common, several, often, hot, levels), "c long, common int, e array<long>, sig array<long>, whole array<long>")
    parts = table(parts.groupBy("c").agg(F.max("common").alias("common"), F.flatten(F.collect_set("e")).alias("e"), F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("sig", "whole")))).alias("asks")), "jaccard-parts")
    dropped(elements)
    asks = asks.drop("sigs").join(parts.select(F.col("c").alias("x"), F.col("common").alias("xk"), F.col("asks").alias("sigs")), "x").where("5 * xk >= 4 * xn")
    members = members.join(parts.select(F.col("c").alias("y"), F.col("common").alias("yk")), "y").where("5 * yk >= 4 * yn")
    # Sets that share none but common fingerprints share the lesser number of those at most.
    able = "x <> y and 9 * least(xk, yk) >= 4 * (xn + yn)"
    place = F.pmod(F.xxhash64("y", F.lit(LEADERS)), F.lit(LEADERS))
    orders = [F.max_by(F.struct("y", "yn", "yk"), F.when(place == r, F.col("yk") / F.col("yn"))) for r in range(LEADERS)]
    orders += [F.min_by(F.struct("y", "yn", "yk"), F.xxhash64("y", F.lit(r))) for r in range(LEADERS)]
    # Two leaders first, which connect most of a group; the others are asked only by sets that are still apart from them.
    rounds = ([orders[0], orders[LEADERS]], [o for i, o in enumerate(orders) if i % LEADERS])
    spread = members.select("y", "yn", "yk", F.inline("sigs")).groupBy("sig")
    lead = table(spread.agg(*[F.array_distinct(F.array_compact(F.array(*o))).alias(f"l{i}") for i, o in enumerate(rounds)]), "jaccard-leaders")
    apart = "not (coalesce(rx = ry, false))"
    found, labels = None, None
    of = lambda df, c, to: df.join(labels.select(F.col("c").alias(c), F.col("root").alias(to)), c, "left")
    for i in range(len(rounds)):
        led = asks.select("x", "xn", "xk", F.col("largest").alias("sig"))
        led = of(led, "x", "rx") if labels is not None else led.withColumn("rx", F.lit(None))
        tries = led.join(lead.select("sig", f"l{i}"), "sig").select("x", "xn", "xk", "rx", F.inline(f"l{i}"))
        tries = tries.where(f"{able} and yn * 5 >= xn * 4 and xn * 5 >= yn * 4")
        if labels is not None:
            tries = of(tries, "y", "ry").where(apart)
        tries = table(tries.select("x", "y").distinct(), "jaccard-tries")
        if labels is not None and tries.isEmpty():
            continue
        more = verified(tries, sets)
        if labels is not None and more.isEmpty():
            continue
        links = table(links.unionByName(more), "jaccard-links")
        found = components(links)
        labels = found.select(F.col("h1").alias("c"), "root")
        # What is connected so far goes on as one edge for each class, to its root, instead of all its links.
        links = found.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("root.h1").alias("b1"), F.col("root.h2").alias("b2"))

    def sides(asks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Sets that ask (x) and sets asked (y), one row for each signature, with their components' least classes."""
        alone = lambda c: F.coalesce(F.col(f"r{c}"), F.struct(F.col(c).alias("h1"), F.lit(0).cast("long").alias("h2")))
        return tuple(of(df, c, f"r{c}").select(c, f"{c}n", f"{c}k", alone(c).alias(f"r{c}"), F.inline("sigs").alias("sig", f"{c}w")) for df, c in ((asks, "x"), (members, "y")))

    # A segment that is the same in both brings them together once, by its signature without a deletion.
    once = "rx <> ry and not (xw = yw and sig <> xw)"
    # A few sets of any two components first, chosen by hash for each signature, and asking by two of theirs: one link
    # settles all other pairs of the two. Only what is still apart then is brought together whole.
    ends = F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")
    held = []
    for i in range(ROUNDS):
        few = []
        two = asks.withColumn("sigs", F.expr(f"slice(array_sort(filter(sigs, s -> s.sig = s.whole)), {2 * i + 1}, 2)"))
        for df, c in zip(sides(two), "xy", strict=True):
            one = F.struct(c, f"{c}n", f"{c}k", f"{c}w")
            some = df.groupBy("sig", f"r{c}").agg(F.array_distinct(F.array(*[F.min_by(one, F.xxhash64(c, F.lit(i * FEW + r))) for r in range(FEW)])).alias("l"))
            few.append(some.select("sig", f"r{c}", F.inline("l")))
        tries = few[0].join(few[1], "sig").where(f"{able} and {once} and yn * 5 >= xn * 4 and xn * 5 >= yn * 4")
        tries = table(tries.select(*ends).distinct(), "jaccard-few")
        held.append(tries)
        more = verified(tries, sets)
        if more.isEmpty():
            break
        links = table(links.unionByName(more), "jaccard-links")
        found = components(links)
        labels = found.select(F.col("h1").alias("c"), "root")
        links = found.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("root.h1").alias("b1"), F.col("root.h2").alias("b2"))
    tries = held[0]
    for t in held[1:]:
        tries = tries.union(t)
    asking, asked_ = sides(asks)
    pairs = asking.join(asked_, "sig").where(f"{able} and {once} and (xn > yn or (xn = yn and x > y)) and yn * 5 >= xn * 4")
    rare = of(parts, "c", "root").select("c", "root", F.explode("e").alias("e"))
    same = rare.toDF("x", "rx", "e").join(rare.toDF("y", "ry", "e"), "e").where(f"x > y and {apart}")
    pairs = pairs.select(*ends).unionByName(same.select(*ends)).distinct()
    rest = table(pairs.join(tries, ["x", "y"], "left_anti"), "jaccard-rest")
    return links if rest.isEmpty() else links.unionByName(verified(rest, sets))


def _less(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows (doc_id, row) in gone; the others keep all their columns and stay out of the join."""
    # The row as one struct: no name that docs may have is in the way.
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_row"))
    rows = marked(rows, gone.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")), ["_id", "_row"])
    gone = gone.select(F.col("doc_id").alias("g_id"), F.col("row").alias("g_row"))
    unsure = rows.where("_maybe").join(gone, F.col("_id").eqNullSafe(F.col("g_id")) & (F.col("_row") == F.col("g_row")), "left_anti")
    return rows.where("not _maybe").select("doc.*").unionByName(unsure.select("doc.*"))


def near_groups(docs: DataFrame, width: int = 5, cap: int = CAP) -> DataFrame:
    """doc_id, row (hash of the text), n_shingles, component_id for each row of docs (doc_id, text).

    Texts link at a similarity of 0.8 or more; component_id is the smallest doc_id that links reach.
    """
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.xxhash64("text").alias("row")).mapInArrow(_sizes(width), "doc_id long, row long, h1 long, h2 long, n long")
    rows = table(rows, "jaccard-docs")
    classes = rows.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "row")).alias("first"), F.max(F.struct("doc_id", "row")).alias("last"))
    classes = table(classes, "jaccard-sizes")
    # One text of each class goes on: signatures and sets of the others would be the same.
    several = classes.where("first <> last").select("h1", "h2", "first")
    copies = table(rows.join(several, ["h1", "h2"]).where("not (doc_id <=> first.doc_id and row = first.row)").select("doc_id", "row").distinct(), "jaccard-copies")
    roots = components(near_links(_less(docs.select("doc_id", "text"), copies).select(text), width, cap))
    classes = classes.select("h1", "h2", "least")
    classes = table(classes.join(roots, ["h1", "h2"], "left").withColumn("root", F.coalesce("root", F.struct("h1", "h2"))), "jaccard-classes")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    found = classes.join(least, "root").select("h1", "h2", "component_id")
    empty = rows.where("n = 0").select("doc_id", "row", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.where("n > 0").join(found, ["h1", "h2"]).select("doc_id", "row", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def without_near_copies(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of docs but those of a group other than its smallest doc_id; rows with one doc_id and text go or stay together."""
    groups = near_groups(docs, width)
    gone = table(groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "row").distinct(), "jaccard-gone")
    return _less(docs, gone)
