"""Bytes of values, sketches and messages: little-endian, with 64-bit lengths before what varies in size.

Sorted 32-bit values travel as differences: a count, then blocks of four differences under a control byte that holds two
bits of width for each, then the rest as they are.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.model import CodecError

#: Fixed value: the most elements that a list may have.
MOST = 256_000_000


def encode_sorted(values: np.ndarray) -> bytes:
    """Ascending values of 32 unsigned bits."""
    v = np.asarray(values, np.int64)
    if len(v) and (v[0] < 0 or v[-1] >> 32 or (np.diff(v) < 0).any()):
        raise CodecError("values must ascend within 32 unsigned bits")
    delta = np.diff(v, prepend=0)
    blocks = len(v) // 4
    head, rest = delta[: blocks * 4].reshape(-1, 4), delta[blocks * 4 :]
    width = 1 + (head >= 1 << 8).astype(np.int64) + (head >= 1 << 16) + (head >= 1 << 24)
    size = 1 + width.sum(1)
    out = np.zeros(int(size.sum()), np.uint8)
    begin = size.cumsum() - size
    out[begin] = ((width - 1) << np.array([0, 2, 4, 6])).sum(1)
    at = begin[:, None] + 1 + width.cumsum(1) - width
    for k in range(4):
        own = width > k
        out[at[own] + k] = (head[own] >> (8 * k)) & 255
    return struct.pack("<Q", len(v)) + out.tobytes() + rest.astype("<u4").tobytes()


def decode_sorted(data: bytes) -> tuple[np.ndarray, int]:
    """(values, bytes read) from the start of ``data``."""
    if len(data) < 8:
        raise CodecError("too short for a count")
    (n,) = struct.unpack_from("<Q", data)
    if n > MOST:
        raise CodecError(f"{n} values are too many")
    raw, at = np.frombuffer(data, np.uint8), 8
    sums = [4 + sum(c >> k & 3 for k in (0, 2, 4, 6)) for c in range(256)]
    begin = np.zeros(n // 4, np.int64)
    for b in range(n // 4):
        if at >= len(raw):
            raise CodecError("too short for its blocks")
        begin[b] = at
        at += 1 + sums[raw[at]]
    if at + 4 * (n % 4) > len(raw):
        raise CodecError("too short for its values")
    width = (raw[begin][:, None].astype(np.int64) >> np.array([0, 2, 4, 6]) & 3) + 1
    place = begin[:, None] + 1 + width.cumsum(1) - width
    delta = np.zeros(width.shape, np.int64)
    for k in range(4):
        own = width > k
        delta[own] |= raw[place[own] + k].astype(np.int64) << (8 * k)
    rest = np.frombuffer(data, "<u4", n % 4, at).astype(np.int64)
    return np.concatenate([delta.ravel(), rest]).cumsum(), at + 4 * (n % 4)


class Writer:
    """Builds a message."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []

    def uint(self, value: int, width: int = 8) -> Writer:
        try:
            self.parts.append(value.to_bytes(width, "little"))
        except OverflowError as e:
            raise CodecError(str(e)) from e
        return self

    def double(self, value: float) -> Writer:
        self.parts.append(struct.pack("<d", value))
        return self

    def text(self, value: str) -> Writer:
        raw = value.encode()
        return self.uint(len(raw)).raw(raw)

    def raw(self, value: bytes) -> Writer:
        self.parts.append(value)
        return self

    def sorted(self, values: np.ndarray) -> Writer:
        return self.raw(encode_sorted(values))

    def window(self, start: int, end: int) -> Writer:
        return self.uint(start).uint(end)

    def done(self) -> bytes:
        return b"".join(self.parts)


class Reader:
    """Takes a message apart, in the order it was built."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def raw(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise CodecError("message ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def uint(self, width: int = 8) -> int:
        return int.from_bytes(self.raw(width), "little")

    def double(self) -> float:
        return struct.unpack("<d", self.raw(8))[0]

    def text(self) -> str:
        n = self.uint()
        if n > MOST:
            raise CodecError(f"{n} bytes are too many")
        try:
            return self.raw(n).decode()
        except UnicodeDecodeError as e:
            raise CodecError(str(e)) from e

    def sorted(self) -> np.ndarray:
        values, n = decode_sorted(self.data[self.at :])
        self.at += n
        return values

    def window(self) -> tuple[int, int]:
        start, end = self.uint(), self.uint()
        if start > end:
            raise CodecError("a window can't end before it starts")
        return start, end


def encode_message(metric: str, start: int, end: int, values: np.ndarray) -> bytes:
    """A window of a metric with all its values, ascending."""
    return Writer().text(metric).window(start, end).sorted(values).done()


def decode_message(data: bytes) -> tuple[str, int, int, np.ndarray]:
    """What ``encode_message`` was given."""
    r = Reader(data)
    return r.text(), *r.window(), r.sorted()


def frame(body: bytes) -> bytes:
    """The body with its length before it."""
    return struct.pack("<Q", len(body)) + body


class Frames:
    """Bodies of a byte stream that arrives in pieces."""

    def __init__(self, most: int = MOST) -> None:
        self.held, self.most = b"", most

    def feed(self, data: bytes) -> list[bytes]:
        self.held += data
        out = []
        while len(self.held) >= 8:
            (n,) = struct.unpack_from("<Q", self.held)
            if n > self.most:
                raise CodecError(f"a frame of {n} bytes is too long")
            if len(self.held) < 8 + n:
                break
            out.append(self.held[8 : 8 + n])
            self.held = self.held[8 + n :]
        return out


def encoded(values: Column) -> Column:
    """Binary column of an array of ascending values."""

    @F.arrow_udf("binary")
    def encode(arrays: pa.Array) -> pa.Array:
        return pa.array([None if a is None else encode_sorted(np.array(a, np.int64)) for a in arrays.to_pylist()], pa.binary())

    return encode(values)


def decoded(data: Column) -> Column:
    """The array of values of a binary column."""

    @F.arrow_udf("array<bigint>")
    def decode(cells: pa.Array) -> pa.Array:
        return pa.array([None if c is None else decode_sorted(c)[0] for c in cells.to_pylist()], pa.list_(pa.int64()))

    return decode(data)
