"""SimHash near-duplicates by deletion-variant signatures (operator 4).

Two fingerprints of 64 bits that differ in at most three bits differ in at most one bit of one of their two halves. Each
half is indexed under its 32 one-wildcard variants (one bit blanked), so such halves share a variant and meet in an
equality grouping; candidates are then verified on all 64 bits. Groups too large to compare pair by pair are divided
again by the other half's pieces, of which one must agree, so no link is lost and no group is collected whole.

``similar_texts`` puts the same index under shingle similarity: fingerprints of word pairs, which edits disturb less, cut
into four segments, so up to seven bits may differ. One fingerprint is too noisy to meet most pairs at the similarity's
edge, so each text has several independent ones, any of which may meet; five-word Jaccard similarity decides. A first pass
tries each text with its nearest only. A second tries all other pairs that meet, except those joined by now and those that
the sizes and parities of their shingle sets prove less similar, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import materialize, release, settle, ship, table

@dataclass(frozen=True)
class Cut:
    """64 bits in 2 or 4 segments: one of them differs by at most one bit, if all differ by at most ``radius``."""

    segments: int = 2

    @property
    def width(self) -> int:
        return 64 // self.segments

    @property
    def radius(self) -> int:
        return 2 * self.segments - 1

    @property
    def piece(self) -> int:
        """Bits of each of radius + 1 pieces of the other segments; one of them agrees."""
        return (64 - self.width) // (self.radius + 1)

    def others(self, slot: int) -> list[int]:
        """Bits of the segments but the slot's."""
        return [k for k in range(64) if k // self.width != slot // self.width]


HALVES, QUARTERS = Cut(2), Cut(4)


def _hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of a text's shingles, in arrays of bounded size; of fewer words that of the whole sequence."""
    words = text.lower().split()
    width = min(width, len(words))
    for a in range(0, len(words) - width + 1 if words else 0, 50_000):
        part = words[a : a + 50_000 + width - 1]
        yield np.frombuffer(b"".join(xxhash.xxh64_digest(s, 42) for s in map(b" ".join, zip(*(part[k:] for k in range(width))))), ">u8")


def lanes(text: bytes, width: int = 3, number: int = 1) -> list[int]:
    """Fingerprints of a text, from the shingles' hashes and from these mixed anew: a bit is set if it is set in over half."""
    ones, n = np.zeros((number, 64), np.int64), 0
    for h in _hashes(text, width):
        n += len(h)
        for k in range(number):
            ones[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            h = h.astype(np.uint64)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))).astype(">u8")
    return [int.from_bytes(np.packbits(row * 2 > n).tobytes(), "big") for row in ones]


def simhash(text: bytes, width: int = 3) -> int:
    """Fingerprint of a text: a bit is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    return lanes(text, width)[0]


def fingerprints(text: Column, width: int = 3, number: int = 1) -> list[Column]:
    """Fingerprints as signed longs; null counts as the empty text, whose fingerprints are zero."""

    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        found = np.array([lanes(t, width, number) for t in texts.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * number, found.ravel())

    found = of(F.coalesce(text, F.lit("")))
    return [found[k] for k in range(number)]


def fingerprint(text: Column, width: int = 3) -> Column:
    """The first of ``fingerprints``."""
    return fingerprints(text, width)[0]


def _bits(column: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(column).view(np.uint64)


class _Nearest:
    """Of pairs of rows, each row with the nearest row of smaller fingerprint; rows that are no one's nearest with themselves.
    Holds one number of each kind per row, however many pairs come."""

    full = False

    def __init__(self, rows: np.ndarray):
        self.fp, self.node = _bits(rows[:, 1]), rows[:, 2]
        self.far, self.low = np.full(len(rows), 65, np.uint8), np.zeros(len(rows), np.int64)
        self.met = np.zeros(len(rows), bool)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Pairs of positions; no position stands twice in ``a`` or twice in ``b``."""
        up = self.fp[a] > self.fp[b]
        for high, low in ((a[up], b[up]), (b[~up], a[~up])):
            far = np.bitwise_count(self.fp[high] ^ self.fp[low])
            old = self.far[high]
            better = (far < old) | ((far == old) & (self.fp[low] < self.fp[self.low[high]]))
            self.far[high[better]], self.low[high[better]] = far[better], low[better]
            self.met[low] = True

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        high = np.flatnonzero(self.far < 65)
        self.met[high] = self.met[self.low[high]] = False
        alone = self.node[self.met]
        return np.r_[self.node[high], alone], np.r_[self.node[self.low[high]], alone]


class _Close:
    """Of pairs of rows, those that may be similar and have different roots, each under one lane and segment only.

    Rows go on behind the piece with root, size of the shingle set, fingerprints of all lanes but the last, parities of the
    set. Two sets differ in at least as many values as their parities in bits.
    """

    def __init__(self, rows: np.ndarray, cut: Cut, number: int, similarity: float, most: int = 1 << 18):
        self.cut, self.similarity, self.most = cut, similarity, most
        self.lane, self.segment = rows[:, 0] >> 38, (rows[:, 0] >> 32 & 63) // cut.width
        self.fp, self.node, self.root, self.n = _bits(rows[:, 1]), rows[:, 2], rows[:, 4], rows[:, 5]
        self.lanes, self.parity = _bits(rows[:, 6 : 5 + number]), _bits(rows[:, 5 + number :])
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    @property
    def full(self) -> bool:
        return self.size > self.most

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        low, high = np.minimum(self.n[a], self.n[b]), np.maximum(self.n[a], self.n[b])
        keep = (self.root[a] != self.root[b]) & (low >= self.similarity * high - 1e-6)
        a, b, most = a[keep], b[keep], (low + high)[keep] * ((1 - self.similarity) / (1 + self.similarity)) + 1e-6
        keep = np.bitwise_count(self.parity[a] ^ self.parity[b]).sum(1, dtype=np.int64) <= most
        a, b = a[keep], b[keep]
        x, again = self.fp[a] ^ self.fp[b], np.zeros(len(a), bool)
        for k in range(self.cut.segments - 1):
            part = x >> np.uint64(k * self.cut.width) & np.uint64((1 << self.cut.width) - 1)
            again |= (self.segment[a] > k) & (np.bitwise_count(part) <= 1)
        for k in range(self.lanes.shape[1]):
            again |= (self.lane[a] > k) & (np.bitwise_count(self.lanes[a, k] ^ self.lanes[b, k]) <= self.cut.radius)
        self.held.append((self.node[a[~again]], self.node[b[~again]]))
        self.size += len(a) - int(again.sum())

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs since the last call."""
        u, v = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (zip(*self.held) if self.held else ((), ())))
        self.held, self.size = [], 0
        return u, v


class _Forest:
    """Of pairs of rows, star links (node, least node) with the same components. Pairs beyond ``most`` are folded as they come."""

    full = False

    def __init__(self, rows: np.ndarray, most: int = 1 << 18):
        self.node, self.most = rows[:, 2], most
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((self.node[a], self.node[b]))
        self.size += len(a)
        if self.size > self.most:
            self.held = [self.links()]
            # what is left doesn't count: there is at most one link of each node
            self.size = 0

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = (np.concatenate(side) for side in zip(*self.held))
        used, at = np.unique(np.r_[a, b], return_inverse=True)
        a, b = at[: len(a)], at[len(a) :]
        root = np.arange(len(used))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            while (new[new] != new).any():
                new = new[new]
            if (new == root).all():
                break
            root = new
        own = root != np.arange(len(used))
        return used[own], used[root[own]]


def _pairs(group: np.ndarray, fp: np.ndarray, slot: np.ndarray, cut: Cut) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked pairs within runs of equal ``group``, a lag at a time. A pair whose segment agrees wholly counts in its first slot only."""
    mask, lag = np.uint64((1 << cut.width) - 1), 1
    while lag < len(group):
        i = np.flatnonzero(group[lag:] == group[:-lag])
        if not len(i):
            break
        x = fp[i] ^ fp[i + lag]
        at = slot[i]
        near = (np.bitwise_count(x) <= cut.radius) & ((((x >> (at // cut.width * cut.width).astype(np.uint64)) & mask) != 0) | (at % cut.width == 0))
        if near.any():
            yield i[near], i[near] + lag
        lag += 1


def _divided(fp: np.ndarray, slot: int, bits: list[int], limit: int, cut: Cut) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of one group, of any size, of distinct fingerprints: divided by each of radius + 1 pieces of ``bits``, one
    of which must agree, as long as that leaves fewer pairs to compare."""
    parts, left = [], 0
    if len(fp) > limit and len(bits) >= 2 * (cut.radius + 1):
        for piece in np.array_split(np.array(bits, np.uint64), cut.radius + 1):
            mask = np.bitwise_or.reduce(np.uint64(1) << piece)
            order = np.argsort(fp & mask, kind="stable")
            cuts = np.flatnonzero(np.diff(fp[order] & mask)) + 1
            parts.append((int(mask), np.split(order, cuts)))
            left += sum(len(own) ** 2 for own in parts[-1][1])
    if not parts or left >= len(fp) ** 2:
        yield from _pairs(np.zeros(len(fp), np.int64), fp, np.full(len(fp), slot), cut)
        return
    for mask, split in parts:
        for own in split:
            if len(own) > 1:
                for a, b in _divided(fp[own], slot, [k for k in bits if not mask >> k & 1], limit, cut):
                    yield own[a], own[b]


def _expanded(a: np.ndarray, b: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows from pairs of fingerprints, of which each has ``count`` rows from ``start`` on."""
    for k in range(count[a].max()):
        own = count[a] > k
        n, first = count[b[own]], start[b[own]]
        yield np.repeat(start[a[own]] + k, n), np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


_LINK = [("hot", pa.bool_()), ("key", pa.int64()), ("fp", pa.int64()), ("u", pa.int64()), ("v", pa.int64())]
_LINK_SQL = "hot boolean, key long, fp long, u long, v long"


def _links(limit: int, final: bool, cut: Cut, kind: Callable[[np.ndarray], _Nearest | _Forest | _Close], more: list[str]):
    """What ``kind`` makes of the linked pairs of rows (key, fp, rep, piece, *more) sorted by (key, piece, fp). Runs longer than
    ``limit`` go on as hot rows, or in the final pass are divided."""

    schema = pa.schema([*_LINK, *((c, pa.int64()) for c in more)])

    def linked(found: _Nearest | _Forest | _Close) -> Iterator[pa.RecordBatch]:
        u, v = found.links()
        if len(u):
            yield pa.record_batch([pa.array(np.zeros(len(u), bool)), pa.array(u), pa.array(u), pa.array(u), pa.array(v), *(pa.nulls(len(u), pa.int64()) for _ in more)], schema=schema)

    def gathered(found: _Nearest | _Forest | _Close, *parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for a, b in chain(*parts):
            found.add(a, b)
            if found.full:
                yield from linked(found)
        yield from linked(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        spilling = None

        def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 3] != rows[:-1, 3])]
            size = np.diff(np.r_[np.flatnonzero(new), len(rows)])
            long = np.repeat(size > limit, size)
            if spilling is not None:
                long |= (rows[:, 0] == spilling[0]) & (rows[:, 3] == spilling[1])
            group = np.cumsum(new)
            if (~long).any():
                r = rows[~long]
                yield from gathered(kind(r), _pairs(group[~long], _bits(r[:, 1]), r[:, 0] >> 32 & 63, cut))
            if not long.any():
                return
            if not final:
                r = rows[long]
                yield pa.record_batch([pa.array(np.ones(len(r), bool)), *(pa.array(r[:, k]) for k in (0, 1, 2, 2, *range(4, 4 + len(more))))], schema=schema)
                return
            for g in np.unique(group[long]):
                r = rows[group == g]
                slot = int(r[0, 0] >> 32 & 63)
                fp, start, same, count = np.unique(_bits(r[:, 1]), return_index=True, return_inverse=True, return_counts=True)
                parts = (_expanded(a, b, start, count) for a, b in _divided(fp, slot, cut.others(slot), limit, cut))
                # rows of one fingerprint agree in all slots and pieces
                alike = _pairs(same, _bits(r[:, 1]), np.full(len(r), slot), cut) if slot == 0 and r[0, 3] < 256 and count.max() > 1 else ()
                yield from gathered(kind(r), chain.from_iterable(parts), alike)

        for batch in batches:
            rows = np.column_stack([c.to_numpy() for c in batch.columns])
            if not len(rows):
                continue
            if held and (held[-1][-1, 0] != rows[0, 0] or held[-1][-1, 3] != rows[0, 3]):
                yield from solve(np.concatenate(held))
                held, spilling = [], None
            # the last run may go on in the next batch; all before it is complete
            same = (rows[:, 0] == rows[-1, 0]) & (rows[:, 3] == rows[-1, 3])
            start = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
            if start:
                yield from solve(np.concatenate([*held, rows[:start]]))
                held, spilling = [], None
            held.append(rows[start:])
            if not final and sum(map(len, held)) > limit:
                spilling = (held[-1][-1, 0], held[-1][-1, 3])
                yield from solve(np.concatenate(held))
                held = []
        if held:
            yield from solve(np.concatenate(held))

    return run


def _indexed(rows: DataFrame, limit: int, cut: Cut, kind: Callable[[np.ndarray], _Nearest | _Forest | _Close]) -> DataFrame:
    """(u, v) that ``kind`` makes of the rows within ``cut.radius`` bits, from (lane, fp, rep, *more): longs, never null, only those
    of one lane compared. Rows of one lane and fingerprint are told apart by ``rep``."""
    w, more = cut.width, rows.columns[3:]
    slots = rows.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(63))))
    key = f"shiftleft(bigint(lane * 64 + slot), 32) | (shiftrightunsigned(fp, int(slot div {w} * {w})) & {(1 << w) - 1}L & ~shiftleft(1L, int(slot % {w})))"
    variants = slots.select(F.expr(key).alias("key"), "fp", "rep", F.lit(0).cast("long").alias("piece"), *more)
    sql = ", ".join([_LINK_SQL, *(f"{c} long" for c in more)])
    first = materialize(variants.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links(limit, False, cut, kind, more), sql), "variants")
    # the bits behind the slot's segment, turned to the low end
    turn = f"int((shiftright(key, 32) % 64 div {w} + 1) * {w} % 64)"
    other = f"(shiftrightunsigned(fp, {turn}) | shiftleft(fp, 64 - {turn}))"
    hot = first.where("hot").select("key", "fp", F.col("u").alias("rep"), *more, F.explode(F.sequence(F.lit(0), F.lit(cut.radius))).alias("b"))
    hot = hot.select("key", "fp", "rep", F.expr(f"shiftleft(bigint(b), 8) | (shiftrightunsigned({other}, {cut.piece} * b) & {(1 << cut.piece) - 1}L)").alias("piece"), *more)
    second = hot.repartition("key", "piece").sortWithinPartitions("key", "piece", "fp").mapInArrow(_links(limit, True, cut, kind, more), sql)
    return first.where("NOT hot").select("u", "v").unionByName(second.select("u", "v"))


def link_fingerprints(reps: DataFrame, limit: int = 2048, cut: Cut = HALVES, nearest: bool = False) -> DataFrame:
    """Links (u, v) that join all fingerprints within ``cut.radius`` bits, from (fp, rep): one row per fingerprint, rep not null.

    Not all pairs: each task reduces what it verified to a forest, or with ``nearest`` to a pair per fingerprint and
    variant, that with the nearest smaller one; one that is within the radius of others but in no such pair comes with
    itself. ``limit`` is the longest run compared pair by pair.
    """
    return _indexed(reps.select(F.lit(0).alias("lane"), "fp", "rep"), limit, cut, _Nearest if nearest else _Forest)


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; of fewer words the whole sequence; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64).view(np.int64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(width))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, len(words) - width + 1).view(np.int64))


def _shingles(text: Column, width: int) -> Column:
    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t, width) for t in texts.cast(pa.binary()).to_pylist()]
        return pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32), np.concatenate([np.zeros(0, np.int64), *sets]))

    return of(F.coalesce(text, F.lit("")))


#: Bits of the parities of a shingle set.
PARITY = 512


def _parity(sets: Column) -> Column:
    """Of each of ``PARITY`` classes of values whether the set has an odd number, as longs."""

    @F.arrow_udf("array<bigint>")
    def of(sets: pa.Array) -> pa.Array:
        n = len(sets)
        row = np.repeat(np.arange(n), sets.value_lengths().to_numpy())
        odd = np.bincount(row * PARITY + (sets.flatten().to_numpy() & (PARITY - 1)), minlength=n * PARITY) % 2
        return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (PARITY // 64), np.packbits(odd.astype(np.uint8)).view(np.int64))

    return of(sets)


def _jaccard(left: str, right: str) -> Column:
    """Similarity of two arrays of distinct values; that of two empty ones is 1."""
    both, all_ = F.size(F.array_intersect(left, right)), F.size(left) + F.size(right)
    return F.when(all_ == 0, 1.0).otherwise(both / (all_ - both))


def similar_texts(
    df: DataFrame, key_col: str, text_col: str = "text", row_col: str | None = None, width: int = 5, similarity: float = 0.8, pairs: int = 2, cut: Cut = QUARTERS, limit: int = 2048, number: int = 3
) -> DataFrame:
    """(key, root) of the keys of ``df`` whose component has a smaller key, keys being non-null longs, each of one text.

    A key may stand on many rows: only the copy with the least ``row_col`` (a long that tells rows apart; without it the
    key) is cut into shingles, and no text is moved to find the copies. Texts of which one of ``number`` fingerprints of
    ``pairs``-word shingles is within ``cut.radius`` bits are links if their ``width``-word Jaccard similarity is at least
    ``similarity``. Tried first are each text with its nearest under every variant, the fingerprints indexed one after
    another, and texts of one fingerprint with the first of them. Then the texts that met any are indexed again, with
    component, size and parities of their shingle sets, and all pairs that these don't rule out are tried. Texts without
    words are similar to each other only, and null is the empty text.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(key_col).alias("key"), F.col(row_col or key_col).alias("row"), F.col(text_col).alias("text"))
    names = [f"fp{k}" for k in range(number)]
    marked = rows.select("key", "row", *(f.alias(c) for f, c in zip(fingerprints(F.col("text"), pairs, number), names)))
    docs = materialize(marked.groupBy("key").agg(F.min("row").alias("row"), *(F.min(c).alias(c) for c in names)), "fingerprints")

    def met(name: str) -> DataFrame:
        own = docs.select("key", F.col(name).alias("fp"))
        reps = materialize(own.groupBy("fp").agg(F.min("key").alias("rep")), "representatives")
        alike = own.join(reps, "fp").where("key <> rep").select(F.col("key").alias("u"), F.col("rep").alias("v"))
        found = link_fingerprints(reps, limit, cut, nearest=True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        return found.unionByName(alike).distinct()

    each = [settle(lambda name=name: met(name), "met") for name in names]
    candidates = materialize(reduce(DataFrame.unionByName, each).distinct(), "candidates")
    release(*each)
    nodes = candidates.select(F.col("u").alias("node")).unionByName(candidates.select(F.col("v").alias("node"))).distinct()
    wanted = materialize(docs.join(nodes, F.col("key") == F.col("node"), "left_semi").select(F.col("row").alias("wanted")), "wanted")
    texts = rows.join(wanted, F.col("row") == F.col("wanted"), "left_semi").dropDuplicates(["row"])
    sets = materialize(texts.select("key", _shingles(F.col("text"), width).alias("s")), "shingles")

    def links(tried: DataFrame) -> DataFrame:
        pair = tried.join(sets.select(F.col("key").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("key").alias("v"), F.col("s").alias("b")), "v")
        return pair.where(_jaccard("a", "b") >= similarity).select("u", "v")

    roots = settle(lambda: components(links(candidates.where("u <> v"))), "roots")
    found = sets.select("key", F.size("s").cast("long").alias("n"), _parity(F.col("s")).alias("parity")).join(docs, "key").join(roots, F.col("key") == F.col("node"), "left")
    found = found.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
    close = found.select(
        "lane", F.array(*names)[F.col("lane")].alias("fp"), F.col("key").alias("rep"), F.coalesce("root", "key").alias("root"), "n", *names[:-1], *(F.col("parity")[k].alias(f"parity{k}") for k in range(PARITY // 64))
    )
    rest = settle(lambda: _indexed(close, limit, cut, partial(_Close, cut=cut, number=number, similarity=similarity)).distinct(), "rest")
    known = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    return components(known.unionByName(links(rest))).select(F.col("node").alias("key"), "root")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, limit: int = 2048) -> DataFrame:
    """One row per row of ``df``: the id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Links join fingerprints within three bits; the component is named by the smallest id reachable. Null and empty texts
    have fingerprint zero and link like any other. A row with a null id links like any other but names no component (null
    if all its ids are null). Repeated rows stay; an id that stands on several texts doesn't tie them.
    Exact copies are one fingerprint, so a group of copies costs one row in the index however large it is.
    """
    docs = materialize(df.select(F.col(id_col).cast("long").alias("id"), fingerprint(F.col(text_col), width).alias("fp")), "fingerprints")
    reps = materialize(docs.groupBy("fp").agg(F.min("id").alias("rep")), "representatives")
    roots = settle(lambda: components(link_fingerprints(reps.select("fp", F.col("fp").alias("rep")), limit)), "roots")
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = materialize(reps.join(linked, F.col("fp") == F.col("node")).select("node", "root", "rep"), "linked")
    least = linked.groupBy("root").agg(F.min("rep").alias("least")).withColumnRenamed("root", "named")
    tied = linked.join(least, F.col("root") == F.col("named")).select("node", "least")
    named = reps.join(tied, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("f"), F.when(F.col("node").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))
    return docs.join(named, F.col("fp") == F.col("f")).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word fingerprints, links at 3 bits; see ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
