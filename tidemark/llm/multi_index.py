"""Approximate nearest neighbours by an inverted multi-index (operator 2).

Vectors are cut into two halves with a codebook each; a vector's entry lies in the cell of its two nearest centroids. A
query scores every centroid of either half and walks the pairs by summed distance with a heap, nearest pair first, until
the cells hold enough entries; those are reranked on the original vectors. Distance is the negative inner product, so
the walk follows the measure that is asked for.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize, ship, table


@dataclass
class Codebooks:
    """Centroids of either half, and the share of the entries that a walk must gather."""

    left: np.ndarray
    right: np.ndarray
    share: float = 1.0


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=k)
        total = np.stack([np.bincount(at, column, k) for column in x.T], 1) if x.shape[1] else np.zeros_like(c)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * x @ c.T).argmin(1)


def walk(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Centroid pairs by summed distance. left, right: a query's distance to each centroid of the halves.

    The heap holds the next pair of every left centroid that has been opened; one is opened when the one before it is used.
    """
    a, b = np.argsort(left, kind="stable").tolist(), np.argsort(right, kind="stable").tolist()
    x, y = np.sort(left).tolist(), np.sort(right).tolist()
    heap = [(x[0] + y[0], 0, 0)]
    while heap:
        _, i, j = heap[0]
        yield a[i], b[j]
        if j + 1 < len(b):
            heapq.heapreplace(heap, (x[i] + y[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))


def fit(sample: np.ndarray, rows: int, k: int = 20, recall: float = 0.95, probes: int = 256) -> Codebooks:
    """Codebooks of a bounded sample, and the share of entries whose cells hold ``recall`` of the true neighbours.

    The share is measured: up to ``probes`` sample vectors are searched exactly among the sample. In the whole table
    neighbours are nearer still, so the share errs towards more work. Centroids per half: a power of two of about half
    the root of ``rows``, from 4 to 256, at most a sixteenth of the distinct vectors of the sample.
    """
    sample = np.unique(sample, axis=0)
    half = sample.shape[1] // 2
    size = int(min(256, max(4, 2 ** round(np.log2(max(1.0, np.sqrt(rows) / 2)))), max(1, len(sample) // 16)))
    books = Codebooks(_kmeans(sample[:, :half], size), _kmeans(sample[:, half:], size))
    if len(sample) <= k + 1:
        return books
    cell = _nearest(sample[:, :half], books.left) * size + _nearest(sample[:, half:], books.right)
    count = np.bincount(cell, minlength=size * size)
    pick = np.random.default_rng(11).choice(len(sample), min(probes, len(sample)), replace=False)
    need = []
    for i in pick:
        score = sample @ sample[i]
        score[i] = -np.inf
        top = np.argpartition(-score, k)[:k]
        far = -(sample[i, :half] @ books.left.T)[:, None] - (sample[i, half:] @ books.right.T)
        order = np.argsort(far.ravel(), kind="stable")
        passed = np.empty(len(order))
        passed[order] = count[order].cumsum() / len(sample)
        need.append(passed[cell[top]])
    books.share = float(np.quantile(np.concatenate(need), recall))
    return books


def dot(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products (queries, entries), added up in a fixed order so equal vectors get equal scores anywhere."""
    out = np.zeros((len(q), len(x)))
    for d in range(x.shape[1]):
        out += q[:, d, None] * x[:, d]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _top(ids: np.ndarray, x: np.ndarray, cells: np.ndarray, qid: np.ndarray, q: np.ndarray, masks: np.ndarray, k: int) -> tuple[list, list, list]:
    """Each query's k best ids of a block, in order, among the entries whose cell is in its mask."""
    rough = q @ x.T
    allowed = masks[:, cells] & (ids[None, :] != qid[:, None])
    rough[~allowed] = -np.inf
    who, where, score = [], [], []
    for r in range(len(q)):
        row = rough[r]
        n = int(allowed[r].sum())
        if not n:
            continue
        most = k
        while True:
            # rounding differs between matrix products, so all that might belong are scored again exactly
            least = np.partition(row, len(row) - most)[len(row) - most] if n > most else -np.inf
            near = np.flatnonzero(allowed[r] & (row >= least - 1e-9 * (1 + abs(least)))) if n > most else np.flatnonzero(allowed[r])
            exact = dot(x[near], q[r : r + 1])[0]
            best = np.lexsort((ids[near], -exact))
            first = np.sort(np.unique(ids[near][best], return_index=True)[1])[:k]
            # an id on several vectors counts once, so there may be too few yet
            if len(first) == k or n <= most:
                break
            most *= 4
        best = best[first]
        who.append(int(qid[r]))
        where.append(ids[near[best]])
        score.append(exact[best])
    return who, where, score


_ENTRY = "id long, v array<double>, asks boolean, i int, j int"
_FOUND = "query_id long, id long, score double"


@dataclass
class _Index:
    """Entries by cell, dealt to shards: runs of left centroids of about ``block_rows`` entries; one left centroid with more
    is a shard of several blocks."""

    books: Codebooks
    count: np.ndarray
    block_rows: int

    def __post_init__(self) -> None:
        own = self.count.sum(1)
        self.shard = np.zeros(len(own), np.int64)
        self.blocks: list[int] = []
        held = 0
        for i, n in enumerate(own):
            if not self.blocks or held + n > self.block_rows:
                self.blocks.append(0)
                held = 0
            held += int(n)
            self.shard[i] = len(self.blocks) - 1
            self.blocks[-1] = max(1, -(-held // self.block_rows))
        self.first = np.searchsorted(self.shard, self.shard)

    def reranked(self, entries: DataFrame, asked: DataFrame, k: int, enough: float) -> DataFrame:
        """(query_id, id, score): up to k of each query row from each block that its walk met."""
        books, count, first, blocks = self.books, self.count, self.first, self.blocks
        shard, n_right, half = self.shard, len(self.books.right), self.books.left.shape[1]
        wide = np.bincount(shard) * n_right  # cells of each shard

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sizes = count.tolist()
            for b in batches:
                q = _matrix(b.column(1))
                at, parts, masks = [], [], []
                for row, v in enumerate(q):
                    met: list[int] = []
                    held = 0
                    for i, j in walk(-(books.left @ v[:half]), -(books.right @ v[half:])):
                        n = sizes[i][j]
                        if n:
                            met.append(i * n_right + j)
                            held += n
                            if held >= enough:
                                break
                    cell = np.array(met)
                    own = shard[cell // n_right]
                    for s in np.unique(own):
                        mask = np.zeros(wide[s], bool)
                        mask[cell[own == s] - np.searchsorted(shard, s) * n_right] = True
                        packed = np.packbits(mask).tobytes()
                        for n in range(blocks[s]):
                            at.append(row)
                            parts.append((s, n))
                            masks.append(packed)
                if at:
                    one = b.take(pa.array(at))
                    where = np.array(parts, np.int32)
                    yield pa.record_batch([one.column(0), one.column(1), pa.array(where[:, 0]), pa.array(where[:, 1]), pa.array(masks, pa.binary())], names=["id", "v", "shard", "block", "mask"])

        routed = asked.select("id", "v").mapInArrow(route, "id long, v array<double>, shard int, block int, mask binary")
        own = F.element_at(F.array(*[F.lit(int(s)) for s in shard]), F.col("i") + 1)
        start = F.element_at(F.array(*[F.lit(int(s)) for s in first]), F.col("i") + 1)
        parts = F.element_at(F.array(*[F.lit(n) for n in blocks]), own + 1)
        cell = (F.col("i") - start) * n_right + F.col("j")
        held = entries.select("id", "v", own.cast("int").alias("shard"), F.pmod(F.xxhash64("id", "v"), parts).cast("int").alias("block"), F.lit(None).cast("binary").alias("mask"), cell.cast("int").alias("cell"))
        both = held.unionByName(routed.withColumn("cell", F.lit(None).cast("int")))

        def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, ids, x, cells = None, [], [], []
            ready = None
            for b in batches:
                shard, block = b.column("shard").to_numpy(), b.column("block").to_numpy()
                is_entry = b.column("mask").is_null().to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(block) != 0) | (np.diff(is_entry.astype(np.int8)) != 0)) + 1
                for a, z in zip(np.r_[0, cuts], np.r_[cuts, len(shard)]):
                    if a == z:
                        continue
                    part = b.slice(a, z - a)
                    if at != (shard[a], block[a]):
                        at, ids, x, cells, ready = (shard[a], block[a]), [], [], [], None
                    vectors = _matrix(part.column("v"))
                    if is_entry[a]:
                        ids.append(part.column("id").to_numpy())
                        x.append(vectors)
                        cells.append(part.column("cell").to_numpy())
                    elif ids:
                        ready = ready or (np.concatenate(ids), np.concatenate(x), np.concatenate(cells))
                        for s in range(0, len(part), 256):
                            few = part.slice(s, 256)
                            bits = np.frombuffer(b"".join(few.column("mask").to_pylist()), np.uint8).reshape(len(few), -1)
                            masks = np.unpackbits(bits, axis=1).astype(bool)
                            who, near, score = _top(*ready, few.column("id").to_numpy(), vectors[s : s + 256], masks, k)
                            if who:
                                n = [len(v) for v in near]
                                yield pa.record_batch([pa.array(np.repeat(who, n)), pa.array(np.concatenate(near)), pa.array(np.concatenate(score))], names=["query_id", "id", "score"])

        # entries first (no mask), then the queries of the same block, streamed past them
        dealt = both.repartition("shard", "block").sortWithinPartitions("shard", "block", F.col("mask").isNotNull(), "id")
        found = dealt.mapInArrow(rerank, _FOUND).repartition("query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _search(rows: DataFrame, width: int, total: int, k: int, sample_rows: int, block_rows: int) -> DataFrame:
    """``search`` among vectors of one length; rows (id, v, asks)."""
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample_rows).select("v").toArrow()["v"].combine_chunks()
    books = fit(_matrix(sample), total, k)
    half = width // 2

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            if len(x):
                cells = [pa.array(_nearest(x[:, :half], books.left).astype(np.int32)), pa.array(_nearest(x[:, half:], books.right).astype(np.int32))]
                yield pa.record_batch([*b.columns, *cells], names=["id", "v", "asks", "i", "j"])

    entries = materialize(rows.mapInArrow(assign, _ENTRY), "cells")
    counted = entries.groupBy("i", "j").agg(F.count("*").alias("n")).toPandas()  # at most 256 * 256 rows
    count = np.zeros((len(books.left), len(books.right)), np.int64)
    count[counted["i"], counted["j"]] = counted["n"]
    index = _Index(books, count, block_rows)
    asked = entries.where("asks")
    found = materialize(index.reranked(entries, asked, k, max(books.share * count.sum(), k + 1)), "nearest")
    # entries that repeat a query's id may leave too few: such queries look into every cell
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("full"))
    short = materialize(asked.join(full, F.col("id") == F.col("full"), "left_anti"), "short")
    if short.isEmpty() or books.share >= 1:
        return found
    rest = index.reranked(entries, short, k, float("inf"))
    return found.join(short.select(F.col("id").alias("again")).distinct(), F.col("query_id") == F.col("again"), "left_anti").unionByName(rest)


def search(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, sample_rows: int = 20_000, block_rows: int = 16_384) -> DataFrame:
    """(query_id, rank, id, score): up to k nearest of every query row by inner product, the row itself (its id) excluded.

    ``is_query`` is a Boolean column. Null, empty, all-zero vectors and those with null, NaN or infinite components take
    no part, nor do null ids. Vectors are compared with those of their own length; each length has an index (there are
    few). Ties go to the smaller id. Rows that repeat an id and vector count once, before anything is sampled or counted;
    an id on several vectors is one candidate by its best, and one query by the best of its rows. Every query gets k rows
    if there are k other ids. The codebooks are fitted on at most ``sample_rows`` vectors, chosen by hash; every row is
    indexed. Shards of cells are cut into blocks of about ``block_rows`` entries, so a hot cell is many blocks. A query
    goes once to each block of the shards that its walk met, with the set of cells to look at; each block answers with at
    most k rows per query, in streams, whatever the query count.
    """
    ship(df.sparkSession)
    vec = F.col(vec_col).cast("array<double>")
    sound = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = materialize(rows.groupBy("id", "v").agg(F.max("asks").alias("asks")), "vectors")
    widths = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"), F.max("asks").alias("asks")).orderBy("w").collect()
    parts = [_search(rows.where(F.size("v") == w["w"]), w["w"], w["n"], k, sample_rows, block_rows) for w in widths if w["asks"]]
    if not parts:
        return df.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    out = parts[0] if len(parts) == 1 else _best(parts, k)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _best(parts: list[DataFrame], k: int) -> DataFrame:
    """The k best of several results, which a query has that stands on vectors of several lengths."""
    found = reduce(DataFrame.unionByName, parts).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, by inner product; see ``search``."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
