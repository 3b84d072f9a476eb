"""Quality classifier (operator 9): a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after the other with a shallow tree on its bins, so the model is a sum of per-feature
lookup tables; a second pass boosts two-feature tables for the pairs that still explain residuals. Scoring adds table
entries of whole batches at once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import held_out, table, trainable

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "symbols", "exclaims", "stops", "digits", "spaces", "pipes",
    "non_ascii", "lines", "distinct_words", "top_word", "distinct_pairs", "repeated_lines", "longest_line",
)
_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digits": b"0123456789",
    "spaces": b" \t\n\r\x0b\x0c", "stops": b".,;:", "exclaims": b"!?", "pipes": b"|", "lines": b"\n",
    "symbols": b"#$%&*@^~=+<>{}[]\\_/`", "non_ascii": bytes(range(128, 256)),
}
_CHUNK = 2 << 20


def _word_features(text: bytes) -> tuple[float, ...]:
    words = text.lower().split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    top = max(Counter(words).values(), default=0)
    pairs = len(set(zip(words, words[1:])))
    return len(words), len(set(words)) / n, top / n, pairs / max(1, len(words) - 1), 1 - len(set(lines)) / m if lines else 0.0, max(map(len, lines), default=0)


def features(texts: pa.Array) -> np.ndarray:
    """A row per text, columns as in FEATURES. Null counts as empty."""
    rows = np.zeros((len(texts), len(FEATURES)))
    texts = texts.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + _CHUNK, "right")) - 1)
        rows[start:end] = _chunk(texts.slice(start, end - start), ends[start : end + 1])
        start = end
    return rows


def _chunk(texts: pa.Array, ends: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    size = np.diff(ends)
    full = size > 0
    count = {}
    for kind, chars in _KINDS.items():
        is_kind = np.zeros(256, np.int64)
        is_kind[list(chars)] = 1
        count[kind] = np.zeros(len(size))
        if full.any():
            count[kind][full] = np.add.reduceat(is_kind[raw], (ends[:-1] - ends[0])[full])
    w = np.array([_word_features(t) for t in texts.to_pylist()]).reshape(len(size), 6)
    n, letters = np.maximum(size, 1), np.maximum(count["upper"] + count["lower"], 1)
    share = {k: v / n for k, v in count.items()}
    cols = {
        "log_bytes": np.log1p(size), "log_words": np.log1p(w[:, 0]), "word_bytes": (size - count["spaces"]) / np.maximum(w[:, 0], 1),
        "upper": count["upper"] / letters, "distinct_words": w[:, 1], "top_word": w[:, 2], "distinct_pairs": w[:, 3],
        "repeated_lines": w[:, 4], "longest_line": np.log1p(w[:, 5]),
    }
    return np.column_stack([cols[f] if f in cols else share[f] for f in FEATURES])


@dataclass
class QualityModel:
    """Bin edges and lookup tables. ``pairs`` holds (feature, feature, table over coarse bins)."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        total = np.full(len(x), self.intercept)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables)):
            total += values[np.searchsorted(edges, x[:, f], "right")]
        for f, g, values in self.pairs:
            total += values[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> np.ndarray:
    """Leaf value of every bin of a depth-limited tree over ordered bins with gradient sums g and curvature sums h."""
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge), -np.inf)
        k = int(gain.argmax())
        if gain[k] > g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
            return np.r_[_tree(g[: k + 1], h[: k + 1], depth - 1, ridge, least), _tree(g[k + 1 :], h[k + 1 :], depth - 1, ridge, least)]
    return np.full(len(g), g.sum() / (h.sum() + ridge))


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """(gain, values) of the best tree that splits a two-feature grid into four quadrants."""
    def parts(z: np.ndarray) -> np.ndarray:
        c = np.pad(z.cumsum(0).cumsum(1), ((1, 0), (1, 0)))[1:, 1:]
        a, row, col, full = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return np.stack([a, row - a, col - a, full - row - col + a])

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    pg, ph = parts(g), parts(h)
    gain = np.where((ph >= least) | (ph < 1e-12), pg**2 / (ph + ridge), 0).sum(0) - g.sum() ** 2 / (h.sum() + ridge)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    v = np.where(ph[:, i, j] >= least, pg[:, i, j] / (ph[:, i, j] + ridge), 0)
    out = np.zeros(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, pair_rounds: int = 60, rate: float = 0.1, bins: int = 32, coarse_bins: int = 12, n_pairs: int = 6, depth: int = 2) -> QualityModel:
    """Cyclic boosting of logistic loss. Without both labels the model is the constant share of label 1 (no rows: 0.5)."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return QualityModel(float(np.log(share / (1 - share))))
    ridge, least = 1.0, 2.0
    prior = float(np.log(y.mean() / (1 - y.mean())))
    model = QualityModel(prior, [_edges(c, bins) for c in x.T], [], [_edges(c, coarse_bins) for c in x.T])
    at = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), prior)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, b in enumerate(at):
            g, h = slopes()
            n = len(model.tables[f])
            step = rate * _tree(np.bincount(b, g, n), np.bincount(b, h, n), depth, ridge, least)
            model.tables[f] += step
            total += step[b]
    low = [np.searchsorted(e, c, "right") for e, c in zip(model.coarse, x.T)]
    g, h = slopes()

    def grid(f: int, k: int, z: np.ndarray) -> np.ndarray:
        shape = len(model.coarse[f]) + 1, len(model.coarse[k]) + 1
        return np.bincount(low[f] * shape[1] + low[k], z, shape[0] * shape[1]).reshape(shape)

    found = sorted(((_quadrants(grid(f, k, g), grid(f, k, h), ridge, least)[0], f, k) for f in range(x.shape[1]) for k in range(f)), reverse=True)[:n_pairs]
    values = {(f, k): np.zeros(grid(f, k, g).shape) for _, f, k in found}
    for _ in range(pair_rounds):
        for f, k in values:
            g, h = slopes()
            step = rate * _quadrants(grid(f, k, g), grid(f, k, h), ridge, least)[1]
            values[f, k] += step
            total += step[low[f], low[k]]
    model.pairs = [(f, k, v) for (f, k), v in values.items()]
    return model


def train(documents: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> QualityModel:
    """Learn from the labelled documents outside the held-out fold, at most ``max_rows`` of them, chosen by hash of the id.

    Rows with a null id or label teach nothing; of repeated labels of an id the larger counts, of repeated documents one.
    """
    labelled = labels.where(trainable(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    @F.arrow_udf("array<double>")
    def vector(texts: pa.Array) -> pa.Array:
        x = features(texts)
        return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())

    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", vector("text").alias("x"))
    got = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy("doc_id").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit(x, got["y"].to_numpy(float))


def quality_score(text: Column, model: QualityModel) -> Column:
    """Column with the model's score of each whole text; null counts as empty."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(features(texts)))

    return score(F.coalesce(text, F.lit("")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; one projection, no shuffle of texts.

    Null and empty texts get the score of a text without words. A null id is in no fold, so it is not held out and teaches
    nothing. Repeated rows stay, each with its score; further columns are ignored.
    """
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(documents, table(spark, sf_dir, "labels"))
    out = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
