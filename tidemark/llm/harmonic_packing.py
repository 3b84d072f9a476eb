"""Harmonic packing (operator 8).

Class k holds pieces of more than capacity/(k+1) and at most capacity/k tokens, so any k of them fill a sequence. Every
worker fills its own sequences of each class with the fixed count k; nothing is exchanged between workers. Documents are
cut at class sizes, which leaves next to no padding, and the few pieces in a worker's unfinished sequences are packed
together at its end, largest first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import ship, table
from tidemark.llm.token_ids import encoded

CAPACITY = 1024


def pieces(n: int, capacity: int = CAPACITY, slack: int = 32) -> list[int]:
    """Lengths that ``n`` tokens are cut into: whole sequences, then class sizes, until the rest wastes at most
    1/``slack`` of its slot or is shorter than capacity/``slack``."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        slot = capacity // k
        if (slot - n) * slack <= slot or n * slack < capacity:
            out.append(n)
            return out
        out.append(capacity // (k + 1))
        n -= out[-1]
    return out


@dataclass
class Packer:
    """One worker's sequences. ``put`` gives the pieces of a sequence that has become full, ``rest`` all others."""

    capacity: int
    first: int
    made: int = 0
    open: dict[int, list[tuple]] = field(default_factory=dict)

    def _seal(self, items: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for item in items:
            out.append((*item, self.first + self.made, offset))
            offset += item[2]
        self.made += 1
        return out

    def put(self, item: tuple) -> list[tuple]:
        """``item[2]`` is its length."""
        k = self.capacity // item[2]
        items = self.open.setdefault(k, [])
        items.append(item)
        return self._seal(self.open.pop(k)) if len(items) == k else []

    def rest(self) -> list[tuple]:
        left = sorted((x for items in self.open.values() for x in items), key=lambda x: -x[2])
        bins: list[list[tuple]] = []
        room: list[int] = []
        for x in left:
            at = next((i for i, r in enumerate(room) if r >= x[2]), None)
            if at is None:
                at = len(bins)
                bins.append([])
                room.append(self.capacity)
            bins[at].append(x)
            room[at] -= x[2]
        self.open.clear()
        return [y for items in bins for y in self._seal(items)]


_SCHEMA = "{id} long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """One row per piece: the document's id, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, and
    ``ids`` (little-endian unsigned 32-bit).

    Every document, null or empty text included, ends with the id ``end``, so it has at least one token. Each id lies in
    exactly one piece. Repeated rows and null ids are packed like any row; further columns are ignored. A sequence's
    number is its input partition's number times 2**33 plus a count; the input must be read in a fixed order (files or a
    table), so a task that runs again gives the same rows. No shuffle; a worker holds at most one unfinished sequence
    per class.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)

        def rows(done: list[tuple]) -> pa.RecordBatch:
            doc, start, length, data, total, sequence, offset = zip(*done)
            longs = [pa.array(x, pa.int64()) for x in (doc, start, length, total, sequence, offset)]
            return pa.record_batch([*longs, pa.array(data, pa.binary())], names=[id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        done: list[tuple] = []
        size = 0
        for docs, ids in encoded(batches, path, end):
            for doc, data in zip(docs, ids):
                total, start = len(data) // 4, 0
                for n in pieces(total, capacity):
                    full = packer.put((doc, start, n, data[4 * start : 4 * (start + n)], total))
                    start += n
                    done += full
                    size += capacity if full else 0
                    if size >= 1 << 19:
                        yield rows(done)
                        done, size = [], 0
        done += packer.rest()
        if done:
            yield rows(done)

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, _SCHEMA.format(id=id_col))


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with their ids' CRC-32 instead of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, null and empty ones as the id 0 alone, in sequences of 1024 tokens; one row per piece."""
    import public_tokenizers

    return digest(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
