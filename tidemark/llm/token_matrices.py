"""Token-id output (operator 5): best-fit-decreasing packing into id matrices.

A segment tree over the remaining capacities finds the open row with the least room that still takes a segment. Overlong
documents are split at row length without loss. Every shard is one ``.npz`` file in the shared folder: ``ids`` (rows by
length, padded with the end id), ``cu_seqlens`` with ``row_ptr`` (each row's cumulative segment lengths), and
``positions`` (restarting at 0 in every segment).
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import new_path, read_bytes, ship, table, write_bytes
from tidemark.llm.token_ids import coder, encoded

LENGTH = 2048
END = 50256


class CapacityTree:
    """Multiset of open rows by remaining capacity, with search for the least capacity of at least n."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, capacity: int, by: int) -> None:
        k = self.leaves + capacity
        while k:
            self.count[k] += by
            k >>= 1

    def push(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def pop(self, n: int) -> tuple[int, int] | None:
        """(capacity, row) with the least capacity >= n, taken out; None if there is none."""
        k = self.leaves + n
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        capacity = k - self.leaves
        self._add(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(row, offset) of each segment, sizes from 1 to capacity; longest first, ties in the given order."""
    tree, place, rows = CapacityTree(capacity), [(0, 0)] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        got = tree.pop(sizes[i])
        room, row = got if got else (capacity, rows)
        rows += got is None
        place[i] = row, capacity - room
        if room > sizes[i]:
            tree.push(room - sizes[i], row)
    return place


def _shard(segments: list[np.ndarray], place: list[tuple[int, int]], length: int, end: int, kind: type) -> bytes:
    rows = 1 + max(r for r, _ in place)
    ids = np.full((rows, length), end, kind)
    positions = np.zeros((rows, length), np.uint16 if length <= 1 << 16 else np.uint32)
    ramp, ends = np.arange(length, dtype=positions.dtype), [[0] for _ in range(rows)]
    for (row, at), seg in sorted(zip(place, segments), key=lambda x: x[0]):
        ids[row, at : at + len(seg)] = seg
        positions[row, at : at + len(seg)] = ramp[: len(seg)]
        ends[row].append(at + len(seg))
    arrays = {"ids": ids, "cu_seqlens": np.array([x for e in ends for x in e], np.int32), "row_ptr": np.cumsum([0, *map(len, ends)], dtype=np.int64), "positions": positions}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, a in arrays.items():
            part = io.BytesIO()
            np.save(part, a)
            z.writestr(f"{name}.npy", part.getvalue(), zipfile.ZIP_STORED if name == "ids" else zipfile.ZIP_DEFLATED, 1)
    return out.getvalue()


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, shard string, row long, offset long"


def write_matrices(df: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, window: int = 4 << 20) -> DataFrame:
    """Write shards into ``folder`` (a URI that executors share) and return their index: one row per segment.

    A task packs windows of about ``window`` tokens, which bounds its memory; a shard is written under a name no other
    attempt uses and only finished tasks' rows name it, so retries leave no trace in the index. Null and empty texts are
    the end id alone. Null ids and repeated rows are written like any row; further columns are ignored. ``ids`` has 16 bits
    if all ids of the vocabulary and ``end`` fit, in every shard alike, else 32.
    """
    import zlib

    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, shards = TaskContext.get(), 0
        kind = np.uint32 if end >= 1 << 16 or coder(path, end).wide() else np.uint16
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal shards, size
            segments = [np.frombuffer(x[3], "<u4") for x in held]
            place = best_fit_decreasing([len(s) for s in segments], length)
            name = f"part-{task.partitionId():06d}-{shards:05d}-{task.taskAttemptId()}.npz"
            write_bytes(f"{folder}/{name}", _shard(segments, place, length, end, kind))
            cols = [[x[0] for x in held], [x[1] for x in held], [x[2] for x in held], [zlib.crc32(x[3]) for x in held], [x[4] for x in held], [name] * len(held), [p[0] for p in place], [p[1] for p in place]]
            shards += 1
            held.clear()
            size = 0
            return pa.record_batch([pa.array(c, pa.string() if i == 5 else pa.int64()) for i, c in enumerate(cols)], names=[x.split()[0] for x in _SCHEMA.split(", ")])

        for docs, ids in encoded(batches, path, end):
            for doc, data in zip(docs, ids):
                total = len(data) // 4
                for start in range(0, total, length):
                    n = min(length, total - start)
                    held.append((doc, start, n, data[4 * start : 4 * (start + n)], total))
                    size += n
                    if size >= window:
                        yield flush()
        if held:
            yield flush()

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA)


def read_shard(uri: str) -> dict[str, np.ndarray]:
    """The arrays of one shard."""
    with np.load(io.BytesIO(read_bytes(uri))) as z:
        return {k: z[k] for k in z.files}


def op5_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of the id matrices of all documents: rows of 2048 ids, <|endoftext|> after each document and as padding."""
    import public_tokenizers

    return write_matrices(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "matrices"))
