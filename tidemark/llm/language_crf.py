"""Language identification (operator 7): a linear-chain conditional random field over the words of a text.

Each word gets potentials from its affixes, character n-grams and lexicon membership; learned transitions tie neighbours,
so code-switched text keeps a language per word. Long words, as those of unspaced scripts, are cut into pieces of at most
PIECE letters, each a word of the chain, so all letters count. Forward-backward runs over the whole text. It is exact and vectorised:
the chain is cut into segments whose transfer matrices are multiplied for all segments at once, short messages then run
from segment to segment, and a last pass over all segments yields every word's marginals.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import held_out, table, trainable

UNKNOWN = "und"
SEGMENT = 32
PIECE = 40
_BATCH_WORDS = 100_000
_CACHE: dict[str, tuple[dict[str, int], list[np.ndarray]]] = {}


def letters_of(token: str) -> str:
    """The token's letters in lower case; empty if it has none."""
    low = token.lower()
    return low if low.isalpha() else "".join(filter(str.isalpha, low))


def pieces(tokens: list[str]) -> list[str]:
    """The tokens, of those longer than PIECE the letters in consecutive pieces of at most PIECE."""
    if max(map(len, tokens), default=0) <= PIECE:
        return tokens
    out: list[str] = []
    for w in tokens:
        if len(w) <= PIECE:
            out.append(w)
        else:
            c = letters_of(w)
            out += [c[a : a + PIECE] for a in range(0, len(c), PIECE)]
    return out


@dataclass
class Crf:
    """labels: language names. lexicon: word to the label that owns it. weights: (hashed features, labels)."""

    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    start: np.ndarray
    move: np.ndarray
    name: str = ""

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(feature ids, word numbers): lexicon entries, and hashed n-grams of the marked word, affixes of 1 to 3 among them."""
        codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.array([len(w) + 2 for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), size)
        ends = size.cumsum()
        room, span = len(self.labels), len(self.weights) - len(self.labels)
        own = np.array([self.lexicon.get(w, -1) for w in words], np.int64)
        ids, owner = [own[own >= 0]], [np.flatnonzero(own >= 0)]
        for n, at in ((2, None), (3, None), (4, ends - size), (4, ends - 4)):
            at = np.arange(max(0, len(codes) - n + 1)) if at is None else at[size >= n]
            at = at[word[at] == word[np.minimum(at + n - 1, len(word) - 1)]]
            h = np.full(len(at), n, np.uint64)
            for k in range(n):
                h = (h ^ codes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            ids.append(room + (h % np.uint64(span)).astype(np.int64))
            owner.append(word[at])
        return np.concatenate(ids), np.concatenate(owner)

    def potentials(self, words: list[str]) -> np.ndarray:
        """Log-potentials (words, labels): the sum of a word's feature weights over the root of their number."""
        ids, owner = self.features(words)
        size = np.maximum(np.bincount(owner, minlength=len(words)), 1)
        return np.stack([np.bincount(owner, w[ids], len(words)) for w in self.weights.T], 1) / np.sqrt(size)[:, None]


def marginals(log_e: np.ndarray, sizes: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Posterior label probabilities of every word. log_e: (words, labels) of all texts in turn; sizes: words per text, >0."""
    n, k = log_e.shape
    if not n:
        return np.zeros((0, k))
    e = np.exp(log_e - log_e.max(1, keepdims=True))
    p0, step = np.exp(start - start.max()), np.exp(move - move.max())
    ends = sizes.cumsum()
    parts = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(sizes)), parts)
    order = np.arange(len(doc)) - np.repeat(parts.cumsum() - parts, parts)
    at = (ends - sizes)[doc][:, None] + order[:, None] * SEGMENT + np.arange(SEGMENT)
    real = at < ends[doc][:, None]
    at = np.minimum(at, n - 1)
    es = np.where(real[:, :, None], e[at], 1.0)
    first = order == 0
    # transfer matrices of whole segments; a text's first step forgets what came before
    a = np.broadcast_to(np.eye(k), (len(doc), k, k)).copy()
    for g in range(SEGMENT):
        nxt = (a.reshape(-1, k) @ step).reshape(-1, k, k)
        if g == 0:
            nxt[first] = p0
        nxt *= es[:, g, None, :]
        nxt /= nxt.max((1, 2), keepdims=True)
        a = np.where(real[:, g, None, None], nxt, a)
    # messages between segments, one step for all texts that have the segment
    base, by_size = parts.cumsum() - parts, np.argsort(-parts, kind="stable")
    left, right = np.full((len(doc), k), 1.0 / k), np.ones((len(doc), k))
    alive = np.searchsorted(-parts[by_size], -np.arange(1, parts.max() + 1), "right")
    for s in range(1, parts.max()):
        i = base[by_size[: alive[s]]] + s
        m = np.einsum("ni,nij->nj", left[i - 1], a[i - 1])
        left[i] = m / m.sum(1, keepdims=True)
    for s in range(parts.max() - 2, -1, -1):
        i = base[by_size[: alive[s + 1]]] + s
        m = np.einsum("nij,nj->ni", a[i + 1], right[i + 1])
        right[i] = m / m.sum(1, keepdims=True)
    # inside the segments
    fwd = np.empty(es.shape)
    m = left
    for g in range(SEGMENT):
        nxt = m @ step
        if g == 0:
            nxt[first] = p0
        nxt *= es[:, g]
        nxt /= nxt.sum(1, keepdims=True)
        m = np.where(real[:, g, None], nxt, m)
        fwd[:, g] = m
    m = right
    for g in range(SEGMENT - 1, -1, -1):
        fwd[:, g] *= m
        nxt = (m * es[:, g]) @ step.T
        nxt /= nxt.sum(1, keepdims=True)
        m = np.where(real[:, g, None], nxt, m)
    out = fwd[real]
    return out / out.sum(1, keepdims=True)


def train_crf(words: list[list[str]], langs: list[str], sequences: int = 3000, length: int = 48, epochs: int = 4, buckets: int = 1 << 15, rate: float = 0.3, seed: int = 7) -> Crf:
    """Learn from texts of known language. Training sequences splice runs of words from random texts, as code-switched
    text does, so transitions between languages are learned too; the likelihood's gradient comes from forward-backward."""
    labels = sorted(set(langs))
    k, rng = len(labels), np.random.default_rng(seed)
    y_of = np.array([labels.index(x) for x in langs])
    seen: Counter[tuple[str, int]] = Counter()
    for ws, y in zip(words, y_of):
        seen.update((w, int(y)) for w in set(ws))
    total: Counter[str] = Counter()
    for (w, _), c in seen.items():
        total[w] += c
    lexicon = {w: y for (w, y), c in seen.items() if c >= 3 and c >= 0.8 * total[w]}
    crf = Crf(labels, lexicon, np.zeros((buckets, k)), np.zeros(k), np.zeros((k, k)))
    if k < 2:
        return crf
    by_label = [np.flatnonzero(y_of == y) for y in range(k)]
    vocab: dict[str, int] = {}
    seq, gold = np.zeros((sequences, length), np.int64), np.zeros((sequences, length), np.int64)
    for r in range(sequences):
        t = 0
        while t < length:
            y = int(rng.integers(k))
            ws = words[int(rng.choice(by_label[y]))]
            run = min(length - t, 1 + int(rng.geometric(1 / 24)), len(ws))
            a = int(rng.integers(len(ws) - run + 1))
            seq[r, t : t + run] = [vocab.setdefault(w, len(vocab)) for w in ws[a : a + run]]
            gold[r, t : t + run] = y
            t += run
    ids, owner = crf.features(list(vocab))
    order = np.argsort(owner, kind="stable")
    flat, size = ids[order], np.bincount(owner, minlength=len(vocab))
    ptr = np.r_[0, size.cumsum()]
    sums = [np.full_like(z, 1e-2) for z in (crf.weights, crf.start, crf.move)]
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(sequences), max(1, sequences // 100)):
            used, where = np.unique(seq[rows], return_inverse=True)
            where = where.reshape(len(rows), length)
            f = np.concatenate([flat[ptr[u] : ptr[u + 1]] for u in used])
            n_f, cuts = size[used], np.r_[0, size[used].cumsum()[:-1]]
            log_e = (np.add.reduceat(crf.weights[f], cuts, axis=0) / np.sqrt(n_f)[:, None])[where]
            e, t = np.exp(log_e - log_e.max(2, keepdims=True)), np.exp(crf.move)
            fw, bw = np.empty_like(e), np.ones_like(e)
            m = np.exp(crf.start) * e[:, 0]
            fw[:, 0] = m / m.sum(1, keepdims=True)
            for i in range(1, length):
                m = (fw[:, i - 1] @ t) * e[:, i]
                fw[:, i] = m / m.sum(1, keepdims=True)
            for i in range(length - 2, -1, -1):
                m = (bw[:, i + 1] * e[:, i + 1]) @ t.T
                bw[:, i] = m / m.sum(1, keepdims=True)
            post = fw * bw
            post /= post.sum(2, keepdims=True)
            both = fw[:, :-1, :, None] * t * (bw[:, 1:] * e[:, 1:])[:, :, None, :]
            both /= both.sum((2, 3), keepdims=True)
            hot = np.eye(k)[gold[rows]]
            diff = hot - post
            at_word = np.stack([np.bincount(where.ravel(), diff[:, :, y].ravel(), len(used)) for y in range(k)], 1) / np.sqrt(n_f)[:, None]
            spread = np.repeat(at_word, n_f, axis=0)
            grads = (
                np.stack([np.bincount(f, spread[:, y], buckets) for y in range(k)], 1) - 1e-3 * crf.weights,
                diff[:, 0].sum(0),
                np.einsum("rti,rtj->ij", hot[:, :-1], hot[:, 1:]) - both.sum((0, 1)),
            )
            for z, s, grad in zip((crf.weights, crf.start, crf.move), sums, grads):
                s += grad**2
                z += rate * grad / np.sqrt(s)
    crf.name = f"{zlib.crc32(crf.weights.tobytes()):08x}"
    return crf


def predict(texts: list[str | None], crf: Crf, cache: int = 200_000) -> tuple[list[str], list[float]]:
    """(language, score) per text; the score is the mean marginal of the language over the words that have letters."""
    if crf.name not in _CACHE:
        _CACHE.clear()
        _CACHE[crf.name] = ({}, [np.zeros((0, len(crf.labels)))])
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    rows: list[list[int]] = []
    which: list[int] = []
    waiting = 0

    def flush() -> None:
        nonlocal waiting
        if rows:
            sizes = np.array([len(r) for r in rows])
            e = _CACHE[crf.name][1][0][np.concatenate(rows)]
            mean = np.add.reduceat(marginals(e, sizes, crf.start, crf.move), np.r_[0, sizes.cumsum()[:-1]], axis=0) / sizes[:, None]
            for i, best, s in zip(which, mean.argmax(1), mean.max(1)):
                lang[i], score[i] = crf.labels[best], float(min(1.0, s))
        rows.clear()
        which.clear()
        waiting = 0

    if not crf.labels:
        return lang, score
    group: list[tuple[int, list[str]]] = []
    for i, text in enumerate(texts):
        group.append((i, pieces((text or "").split())))
        waiting += len(group[-1][1])
        if waiting < _BATCH_WORDS and i + 1 < len(texts):
            continue
        index, held = _CACHE[crf.name]
        if len(index) > cache:
            index.clear()
            held[0] = held[0][:0]
        new = [w for w in set().union(*(ws for _, ws in group)) if w not in index]
        clean = [letters_of(w) for w in new]
        n = len(held[0])
        held[0] = np.concatenate([held[0], crf.potentials([c for c in clean if c])])
        for w, c in zip(new, clean):
            index[w] = n if c else -1
            n += bool(c)
        for j, ws in group:
            at = np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))
            at = at[at >= 0]
            if len(at):
                rows.append(at)
                which.append(j)
        group = []
        flush()
    return lang, score


def train(documents: DataFrame, per_language: int = 400, chars: int = 50_000) -> Crf:
    """Learn from documents outside the held-out fold with a language: about ``per_language`` of each, chosen by hash.

    Expected counts are met by a hash threshold per language; at most twice as many rows in all reach the driver, of a
    document longer than ``chars`` a stretch of that length that begins at a place chosen by hash. Labels are few (a
    language list). Rows with a null id teach nothing, repeated ids and texts are samples each, in an order that their
    content fixes. No usable row: a model without labels, which predicts ``und`` always.
    """
    rows = documents.where(trainable(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Crf([], {}, np.zeros((2, 0)), np.zeros(0), np.zeros((0, 0)))
    space = 1 << 30
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, int(space * min(1.0, per_language / n)) if n > per_language else space).otherwise(share)
    key = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(space))
    start = F.pmod(F.xxhash64("doc_id", F.lit("start")), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    sampled = F.substring("text", start, F.lit(chars)).alias("text")
    got = rows.where(key < share).select(sampled, "lang", key.alias("key"), "doc_id").orderBy("key", "doc_id", "lang", "text").limit(2 * per_language * len(counts)).toPandas()
    words = [[c for c in map(letters_of, pieces((t or "").split())) if c] for t in got["text"]]
    kept = [(w, x) for w, x in zip(words, got["lang"]) if w]
    return train_crf([w for w, _ in kept], [x for _, x in kept])


def language(text: Column, crf: Crf) -> Column:
    """Struct column (lang_pred, score) of whole texts. ``und`` with score 0 if the text is null or has no letter."""

    @F.arrow_udf("lang_pred string, score double")
    def label(texts: pa.Array) -> pa.Array:
        lang, score = predict(texts.to_pylist(), crf)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return label(text)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; one projection, no shuffle of texts.

    Null texts and those without letters are ``und`` with score 0; of equal scores the first language by name counts. A null
    id is in no fold, so it is not held out and teaches nothing. Repeated rows stay; further columns are ignored.
    """
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    crf = train(documents)
    out = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language(F.col("text"), crf).alias("found"))
    return out.select("doc_id", "held_out", "found.lang_pred", "found.score")
