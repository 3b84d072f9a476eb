"""Benchmark decontamination (operator 1).

All n-grams of every test item are its seeds. A seed in a document joins it to the item and gives the diagonal. Passages
whose words cannot reach the threshold, in whatever order, are set aside by a bound; Smith-Waterman alignment of the item
with each other passage then scores exact, edited and paraphrased copies alike. Items too short to align are found as exact
phrases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import ship, table

GRAM = 2
THRESHOLD = 0.4
LEAST_WORDS = 5
MATCH, MISMATCH, GAP = 2, -1, 1

#: ASCII letters and digits are kept (lower case), other ASCII separates words, all else belongs to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63)]
#: Scripts written without spaces (Thai, Lao, Burmese, Khmer, kana, Han): each of their characters is a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_CHUNK = 2 << 20
_HITS = 1 << 20


class _Words(dict):
    """Hash of each word, computed once for those of up to 64 bytes."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_WORDS = _Words()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words."""
    text = text or ""
    if not text.isascii():
        text = _UNSPACED.sub(r" \g<0> ", text)
    words = text.encode().translate(_FOLD).split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def grams(words: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of the n-gram that starts at each word."""
    n = len(words) - size + 1
    h = np.zeros(max(0, n), np.uint64)
    for k in range(size if n > 0 else 0):
        h = (h ^ words[k : k + n]) * _MIX[k]
        h ^= h >> np.uint64(31)
    return h


class GramSet:
    """Sorted n-gram hashes behind a bitmap that most others don't pass."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes)
        self.shift = np.uint64(64 - max(16, min(26, int(len(self.hashes) * 64).bit_length())))
        self.bitmap = np.zeros(1 << int(64 - self.shift), bool)
        self.bitmap[self.hashes >> self.shift] = True

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in g that are in the set, their places in ``hashes``)."""
        at = np.flatnonzero(self.bitmap[g >> self.shift])
        if not len(at):
            return at, at
        place = np.minimum(np.searchsorted(self.hashes, g[at]), len(self.hashes) - 1)
        ok = self.hashes[place] == g[at]
        return at[ok], place[ok]


@dataclass
class Seeds:
    """A block of test items: their words, seed places (item, position) grouped by n-gram, and the words of all items."""

    items: list[np.ndarray]
    grams: GramSet
    start: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    words: GramSet
    short: dict[int, tuple[GramSet, list[list[int]]]]


def all_seeds(items: list[np.ndarray]) -> Seeds:
    """Every n-gram of every item of LEAST_WORDS or more, and the shorter ones whole."""
    short: dict[int, tuple[GramSet, list[list[int]]]] = {}
    for n in range(1, LEAST_WORDS):
        own = [i for i, words in enumerate(items) if len(words) == n]
        if own:
            phrase = GramSet(np.concatenate([grams(items[i], n) for i in own]))
            who: list[list[int]] = [[] for _ in phrase.hashes]
            for i in own:
                who[phrase.find(grams(items[i], n))[1][0]].append(i)
            short[n] = phrase, who
    long = [i for i, words in enumerate(items) if len(words) >= LEAST_WORDS]
    none = np.zeros(0, np.uint64)
    h = np.concatenate([none, *(grams(items[i]) for i in long)])
    size = np.array([len(items[i]) - GRAM + 1 for i in long], np.int64)
    item, pos = np.repeat(np.array(long, np.int64), size), np.arange(len(h)) - np.repeat(size.cumsum() - size, size)
    order = np.argsort(h, kind="stable")
    found = GramSet(h)
    start = np.searchsorted(h[order], found.hashes)
    return Seeds(items, found, np.r_[start, len(h)], item[order], pos[order], GramSet(np.concatenate([none, *items])), short)


def reachable(own: np.ndarray) -> np.ndarray:
    """Upper bound of the alignment scores of passages (rows) by which of their words the item has: within the aligned
    stretch such a word adds MATCH at most, and each other word costs a mismatch or a gap."""
    total = np.where(own, MATCH, -min(GAP, -MISMATCH)).cumsum(1)
    before = np.minimum.accumulate(np.concatenate([np.zeros((len(own), 1), np.int64), total[:, :-1]], 1), axis=1)
    return (total - before).max(1)


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of one item with many windows (rows, -1-padded by 0): (best scores, end columns)."""
    n, w = windows.shape
    slope = np.arange(w) * GAP
    h, best, end = np.zeros((n, w + 1), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for word in item:
        e = np.maximum(h[:, :-1] + np.where(windows == word, MATCH, MISMATCH), np.maximum(h[:, 1:] - GAP, 0))
        h[:, 1:] = np.maximum.accumulate(e + slope, axis=1) - slope
        at = h[:, 1:].argmax(1)
        top = h[np.arange(n), at + 1]
        better = top > best
        best, end = np.where(better, top, best), np.where(better, at, end)
    return best, end


def _scan(ids: list, docs: list[np.ndarray], seeds: Seeds, threshold: float) -> list[tuple]:
    """(doc id, item, score, first word, last word, words) of the documents of one chunk, best passage of each pair."""
    out: list[tuple] = []
    sizes = np.array([len(x) for x in docs], np.int64)
    flat, base = np.concatenate([*docs, np.zeros(0, np.uint64)]), sizes.cumsum() - sizes
    owner = np.repeat(np.arange(len(docs)), sizes)
    for n, (phrase, who) in seeds.short.items():
        at, place = phrase.find(grams(flat, n))
        inside = owner[at] == owner[at + n - 1]
        # the first place of each phrase in each document
        pair, first = np.unique(owner[at[inside]] * len(who) + place[inside], return_index=True)
        for p, x in zip(pair.tolist(), at[inside][first].tolist()):
            d = p // len(who)
            out += [(ids[d], i, 1.0, x - int(base[d]), x - int(base[d]) + n - 1, int(sizes[d])) for i in who[p % len(who)]]
    at, place = seeds.grams.find(grams(flat))
    inside = owner[at] == owner[np.minimum(at + GRAM - 1, len(owner) - 1)] if len(at) else at > 0
    at, place = at[inside], place[inside]
    if not len(at):
        return out
    length = np.array([len(x) for x in seeds.items], np.int64)
    margin = np.maximum(8, length // 4)
    known = np.full(len(flat), len(seeds.words.hashes), np.int64)
    known_at, known_word = seeds.words.find(flat)
    known[known_at] = known_word
    best: dict[tuple[int, int], tuple] = {}
    per = seeds.start[place + 1] - seeds.start[place]
    # pairs of a hit and an item in bounded slices; a passage that two slices meet is aligned twice
    for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(per.cumsum() // _HITS)) + 1):
        _best_passages(at[own], place[own], per[own], owner, base, sizes, flat, known, margin, seeds, threshold, best)
    return out + [(ids[d], i, float(s), -x, y, int(sizes[d])) for (d, i), (s, x, y) in best.items()]


def _best_passages(at: np.ndarray, place: np.ndarray, per: np.ndarray, owner: np.ndarray, base: np.ndarray, sizes: np.ndarray, flat: np.ndarray, known: np.ndarray, margin: np.ndarray, seeds: Seeds, threshold: float, best: dict[tuple[int, int], tuple]) -> None:
    """Align the passages around seed hits and keep the best of each (document, item) in ``best``."""
    k = np.repeat(seeds.start[place], per) + np.arange(per.sum()) - np.repeat(per.cumsum() - per, per)
    doc, item = np.repeat(owner[at], per), seeds.item[k]
    diagonal = np.repeat(at - base[owner[at]], per) - seeds.pos[k]
    cell = np.floor_divide(diagonal, margin[item])
    low, docs = cell.min(), len(sizes)
    span = cell.max() - low + 1
    key = np.unique((item * docs + doc) * span + cell - low)
    windows = np.column_stack([key // span // docs, key // span % docs, key % span + low])
    for part in np.split(windows, np.flatnonzero(np.diff(windows[:, 0])) + 1):
        i = int(part[0, 0])
        w = seeds.items[i]
        has = np.zeros(len(seeds.words.hashes) + 1, bool)
        has[seeds.words.find(w)[1]] = True
        width = len(w) + 3 * int(margin[i])
        step = max(1, (1 << 20) // width)
        for a in range(0, len(part), step):
            rows = part[a : a + step]
            first = rows[:, 2] * margin[i] - margin[i]
            col = first[:, None] + np.arange(width)
            ok = (col >= 0) & (col < sizes[rows[:, 1]][:, None])
            place = np.clip(base[rows[:, 1]][:, None] + col, 0, len(flat) - 1)
            able = np.flatnonzero(reachable(has[known[place]] & ok) >= threshold * MATCH * len(w))
            if not len(able):
                continue
            rows, first = rows[able], first[able]
            text = np.where(ok[able], flat[place[able]], np.uint64(0))
            score, end = align(w, text)
            hit = np.flatnonzero(score >= threshold * MATCH * len(w))
            if not len(hit):
                continue
            # the same alignment read backwards from its end finds where it begins
            back = np.where(np.arange(width) <= end[hit][:, None], text[hit], np.uint64(0))[:, ::-1]
            begin = width - 1 - align(w[::-1], back)[1]
            for r, s, x, y in zip(hit, score[hit], begin, end[hit]):
                key, value = (int(rows[r, 1]), i), (s / (MATCH * len(w)), -int(first[r] + x), int(first[r] + y))
                best[key] = max(best.get(key, value), value)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, word hashes) of documents in chunks of bounded size."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size < _CHUNK):
                size += len(texts[stop] or "")
                stop += 1
            if len(_WORDS) > 500_000:
                _WORDS.clear()
            yield ids[start:stop], [word_hashes(t) for t in texts[start:stop]]
            start = stop


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block_bytes: int = 16 << 20) -> DataFrame:
    """(id, item_id, score, first_word, last_word, item_words, doc_words): pairs of a document and a test item that it copies, wholly
    or edited.

    ``score`` is the alignment score over that of a perfect copy, ``threshold`` or more; the word positions are those of
    the best passage. Items of fewer than five words are too short to align: they count where their words stand together,
    with score 1, at the first such place; ``item_words``, the item's length, tells them. Characters of unspaced scripts are words. Items go to
    the workers in blocks of about ``block_bytes`` of distinct text, one pass over the documents for each, so what is sent
    is bounded; no document is shuffled. Equal items are aligned once. Items or documents that are null or without words
    pair with nothing; repeated rows, and ties, give a result each; further columns are ignored.
    """
    ship(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text", F.xxhash64("text").alias("key"))
    texts = items.groupBy("text", "key").agg(F.lit(1))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    result = None
    for b in range(blocks):
        rows = texts.where(F.pmod("key", F.lit(blocks)) == b).orderBy("key", "text").collect()
        words = [word_hashes(r["text"]) for r in rows]
        keys = np.array([r["key"] for r in rows], np.int64)
        seeds = all_seeds(words)

        def run(batches: Iterator[pa.RecordBatch], seeds: Seeds = seeds, keys: np.ndarray = keys) -> Iterator[pa.RecordBatch]:
            length = np.array([len(x) for x in seeds.items], np.int64)
            for ids, texts in _chunks(batches):
                found = _scan(ids, texts, seeds, threshold)
                if found:
                    doc, item, score, first, last, size = zip(*found)
                    own = np.array(item)
                    cols = [pa.array(doc, pa.int64()), pa.array(keys[own]), pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(length[own]), pa.array(size, pa.int64())]
                    yield pa.record_batch(cols, names=["id", "key", "score", "first_word", "last_word", "item_words", "doc_words"])

        part = docs.mapInArrow(run, "id long, key long, score double, first_word long, last_word long, item_words long, doc_words long")
        result = part if result is None else result.unionByName(part)
    names = items.select("item_id", F.col("key").alias("own"))
    return result.join(names, F.col("key") == F.col("own")).select(F.col("id").alias(id_col), "item_id", "score", "first_word", "last_word", "item_words", "doc_words")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a test item of the benchmark that it holds, with the best passage: see ``contaminated``."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
