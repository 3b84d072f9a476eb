"""Byte-pair encoding by rank-synchronous merging of ragged arrays, and a cache of text chunks.

A batch of pre-tokens is one flat array of symbols with the sequence number of each symbol beside it. Every round finds
each sequence's lowest-rank adjacent pair and merges all of that pair's places in all sequences at once; a sequence
without a mergeable pair leaves the batch. Merging all places of a pair together gives what one-by-one merging gives,
since a pair that holds the new symbol always ranks after the pair that made it. Pre-tokens of thousands of bytes, as in
unspaced scripts, go by the same order of ranks over a linked list, so a round costs what it merges.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array

import numpy as np
import regex
from tokenizers.pre_tokenizers import ByteLevel

#: Fixed values of byte-level BPE: the pre-token pattern, and the bytes that stand for themselves in its alphabet.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

#: A single space between two non-spaces always begins a pre-token, so texts can be cut there.
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_TWO_SPACES = re.compile(r"\s\s")
_NONE = np.int64(1) << 40
#: Bytes from which a word is merged by places; characters up to which a chunk's count is kept.
LONG_WORD = 2048
KEPT = 32


def byte_alphabet() -> dict[int, str]:
    """The printable character of each byte."""
    out = {b: chr(b) for b in PRINTABLE_BYTES}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(PRINTABLE_BYTES))
    return out


def cut(text: str) -> list[str]:
    """Pieces that encode independently: the first as it stands, every other with one space before it."""
    return _SAFE_CUT.split(text) if _TWO_SPACES.search(text) else text.split(" ")


class PairTable:
    """Rank and product of each mergeable pair in an open-addressing table of numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, product: np.ndarray) -> None:
        keys = (left.astype(np.int64) << 32) | right
        self.bits = max(8, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks, self.products = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64), np.zeros(size, np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] < 0
            _, first = np.unique(at[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[at[put]], self.ranks[at[put]], self.products[at[put]] = keys[put], put, product[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = np.where(self.keys[at[todo]] >= 0, (at[todo] + 1) & (size - 1), at[todo])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ranks, products); a pair that can't be merged has the rank _NONE."""
        keys = (left << 32) | right
        at = self._slot(keys)
        got = self.keys[at]
        todo = np.flatnonzero((got != keys) & (got >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            got[todo] = self.keys[at[todo]]
            todo = todo[(got[todo] != keys[todo]) & (got[todo] >= 0)]
        hit = got == keys
        return np.where(hit, self.ranks[at], _NONE), self.products[at]


class RankMerger:
    """The merges of a byte-level BPE vocabulary in the JSON form of ``tokenizers``."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer merges here")
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        self.pairs = PairTable(ids[:, 0], ids[:, 1], ids[:, 2])
        self.ids = ids
        self._ranked: dict[tuple[int, int], int] = {}
        self.of_byte = np.array([vocab[c] for _, c in sorted(byte_alphabet().items())], np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        self.library = ByteLevel(add_prefix_space=False)

    def words(self, chunk: str) -> list[str]:
        """Pre-tokens. Two libraries may know different Unicode versions, so the vocabulary's own splits rare scripts."""
        if chunk.isascii() or max(chunk) < "\u0250":
            return self.pattern.findall(chunk)
        return [chunk[a:b] for _, (a, b) in self.library.pre_tokenize_str(chunk)]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each word)."""
        long = {i: self.merge_long(w) for i, w in enumerate(words) if len(w) > LONG_WORD}
        if not long:
            return self._merge_short(words)
        ids, sizes = self._merge_short([b"" if i in long else w for i, w in enumerate(words)])
        parts = np.split(ids, sizes.cumsum()[:-1])
        for i, got in long.items():
            parts[i], sizes[i] = got, len(got)
        return np.concatenate(parts), sizes

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: the lowest rank's places all at once, found by buckets of places instead of over the word."""
        if not self._ranked:
            self._ranked.update({(a, b): r for r, (a, b, _) in reversed(list(enumerate(self.ids.tolist())))})
        ranked, made = self._ranked, self.ids.tolist()
        n = len(word)
        of = self.of_byte.tolist()
        symbol = array("i", [of[b] for b in word])
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        places: dict[int, list[int]] = {}

        def note(i: int, j: int) -> None:
            rank = ranked.get((symbol[i], symbol[j]))
            if rank is not None:
                if rank not in places:
                    places[rank] = []
                    heapq.heappush(heap, rank)
                places[rank].append(i)

        heap: list[int] = []
        for i in range(n - 1):
            note(i, i + 1)
        while heap:
            rank = heapq.heappop(heap)
            a, b, new = made[rank]
            for i in sorted(places.pop(rank)):
                j = after[i]
                if symbol[i] != a or j >= n or symbol[j] != b:
                    continue
                symbol[i], symbol[j] = new, -1
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    note(i, k)
                if before[i] >= 0:
                    note(before[i], i)
        out = np.frombuffer(symbol, np.int32).astype(np.int64)
        return out[out >= 0]

    def _merge_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(w) for w in words], np.int64)
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_seq = [], []
        rank, product = self._ranks(ids, seq)
        while len(ids):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(ids)]))
            over = least == _NONE
            if over.any():
                done_ids.append(ids[over])
                done_seq.append(seq[over])
                ids, seq, rank, product, least = (x[~over] for x in (ids, seq, rank, product, least))
                if not len(ids):
                    break
            take = rank == least
            # places of one pair that overlap, as in "aaa", merge from the left: every other one of a run
            at = np.flatnonzero(take)
            first = np.r_[True, np.diff(at) > 1]
            at = at[(at - at[first][np.cumsum(first) - 1]) % 2 == 0]
            ids[at] = product[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            ids, seq, rank, product = ids[keep], seq[keep], rank[keep], product[keep]
            again = np.concatenate([moved, moved[moved > 0] - 1])
            rank[again], product[again] = self._ranks(ids, seq, again)
        if not done_ids:
            return np.zeros(0, np.int64), sizes * 0
        ids, seq = np.concatenate(done_ids), np.concatenate(done_seq)
        return ids[np.argsort(seq, kind="stable")], np.bincount(seq, minlength=len(words))

    def _ranks(self, ids: np.ndarray, seq: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(len(ids)) if at is None else at
        nxt = np.minimum(at + 1, len(ids) - 1)
        rank, product = self.pairs.find(ids[at], ids[nxt])
        return np.where((nxt > at) & (seq[nxt] == seq[at]), rank, _NONE), product


class TokenCounter:
    """Tokens of whole texts, as ``tokenizers`` counts them without added special tokens.

    Chunks of up to KEPT characters that were seen before are looked up; the two tables are emptied when they reach
    ``cache`` entries, so their bytes are bounded. Longer chunks, whole texts in unspaced scripts, are not kept.
    """

    def __init__(self, path: str, cache: int = 800_000, batch_bytes: int = 2 << 20) -> None:
        self.merger, self.cache, self.batch_bytes = RankMerger(path), cache, batch_bytes
        self.head: dict[str, int] = {}
        self.tail: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        group: list[tuple[int, list[list[str]]]] = []
        size = 0
        for text in texts:
            specials, parts = 0, [text]
            for s in self.merger.special:
                if s in text:
                    parts = [p for x in parts for p in x.split(s)]
                    specials += text.count(s)
            group.append((specials, [cut(p) for p in parts]))
            size += len(text)
            if size >= self.batch_bytes:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, group: list[tuple[int, list[list[str]]]]) -> list[int]:
        if len(self.head) + len(self.tail) > self.cache:
            self.head.clear()
            self.tail.clear()
        heads = {p[0] for _, parts in group for p in parts if p[0] not in self.head}
        tails = set().union(*(p[1:] for _, parts in group for p in parts)).difference(self.tail)
        chunks = [*heads, *(f" {t}" for t in tails)]
        words = [self.merger.words(c) for c in chunks]
        distinct = {w: k for k, w in enumerate(dict.fromkeys(x for ws in words for x in ws))}
        sizes = self.merger.merge([w.encode() for w in distinct])[1].tolist()
        counts = [sum(sizes[distinct[w]] for w in ws) for ws in words]
        self.head.update(zip(heads, counts))
        self.tail.update(zip(tails, counts[len(heads) :]))
        head, tail = self.head, self.tail.__getitem__
        found = [n + sum(head[p[0]] + sum(map(tail, p[1:])) for p in parts) for n, parts in group]
        for seen, new in ((self.head, heads), (self.tail, tails)):
            for c in new:
                if len(c) > KEPT:
                    del seen[c]
        return found
