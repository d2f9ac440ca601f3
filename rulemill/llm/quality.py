"""Quality scores by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_text, saved, text_of

#: Labelled rows that a model is fitted on at most, those of the smallest hashes.
FIT_ROWS = 20_000

FEATURES = (
    "log_chars", "log_words", "word_len", "word_len_sd", "longest_word", "upper", "digit", "space", "period", "comma", "bang", "mark", "bar", "bracket", "other_punct", "non_ascii",
    "caps_words", "short_words", "distinct_words", "top_word", "log_lines", "line_len", "distinct_lines", "top_line",
)


def statistics(text: str) -> list[float]:
    """The features of one text, in the order of FEATURES; all are defined for empty texts."""
    raw = text.encode()
    n, count = max(1, len(raw)), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    w, lens = max(1, len(words)), np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    of = lambda chars: float(count[list(chars)].sum()) / n
    known, rows = Counter(words), Counter(lines)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), lens.mean(), lens.std(), min(float(lens.max()), 1e4), count[65:91].sum() / n, count[48:58].sum() / n, of(b" \t\n\r"), of(b"."), of(b","), of(b"!"), of(b"#$%&*@^~"), of(b"|"), of(b"()[]{}<>"), of(b"\"'-:;?/\\_+=`"), count[128:].sum() / n,
        sum(map(bytes.isupper, words)) / w, float((lens <= 3).sum()) / w, len(known) / w, max(known.values(), default=0) / w, np.log1p(len(lines)), np.log1p(n / len(lines)), len(rows) / len(lines), max(rows.values()) / len(lines),
    ]


class Trees(NamedTuple):
    """Complete binary trees of one depth, flattened: node i has children 2i+1 and 2i+2."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # go right if the value is greater
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, all rows of `x` walking down one tree at a time."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(inner.bit_length()):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return 1 / (1 + np.exp(-out))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, penalty: float = 2.0, least: float = 2.0) -> Trees:
    """Boosting on the log loss with histograms of `bins` quantile bins, level by level."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(1) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n else np.zeros((0, k), np.int64)
    mean = (y.sum() + 1) / (n + 2)
    base, inner = float(np.log(mean / (1 - mean))), 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    raw = np.full(n, base)
    for t in range(trees if n else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h, node = y - p, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best, choice, cut = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, np.inf)
            for j in range(k):
                key = at * bins + binned[:, j]
                gs = np.bincount(key, g, width * bins).reshape(width, bins)
                hs = np.bincount(key, h, width * bins).reshape(width, bins)
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                ga, ha = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + penalty) + (ga - gl) ** 2 / (ha - hl + penalty) - ga**2 / (ha + penalty)
                gain[(hl < least) | (ha - hl < least)] = -1
                gain = gain[:, : len(edges[j])]
                if gain.shape[1]:
                    top = gain.argmax(1)
                    value = gain[np.arange(width), top]
                    better = value > best
                    best[better], choice[better], cut[better] = value[better], j, edges[j][top[better]]
            feature[t, first : first + width], threshold[t, first : first + width] = choice, cut
            node = 2 * node + 1 + (x[np.arange(n), choice[at]] > cut[at])
        at = node - inner
        leaf[t] = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + penalty)
        raw += leaf[t][at]
    return Trees(feature, threshold, leaf, base)


def statistics_column(text: Column) -> Column:
    return by_text(lambda texts: [list(map(float, statistics(x))) for x in texts], "array<double>", pa.list_(pa.float64()))(text)


def is_held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the doc_id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> Trees:
    """A model of `label` from at most `fit_rows` labelled rows outside the held-out fold,
    those of the smallest hashes of doc_id. Null labels teach nothing; without any labelled
    row every score is one half."""
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = saved(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "fit")
    texts = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(chosen), "doc_id")
    # Repeated rows of a doc_id teach once; the rows are sorted so that reruns agree.
    rows = texts.select("doc_id", "y", statistics_column(F.col("text")).alias("x")).groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x")).toPandas().sort_values("doc_id")
    x = np.array(rows.x.tolist(), float) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit_trees(x, rows.y.to_numpy(float))


def score_column(text: Column, model: Trees) -> Column:
    return by_text(lambda texts: model.score(np.array([statistics(x) for x in texts], float)), "double", pa.float64())(text)


def score(docs: DataFrame, model: Trees, threshold: float = 0.3) -> DataFrame:
    """Adds score (0 to 1, higher for better) and predicted (1 from `threshold` on) to every
    row, from its whole text alone; null counts as empty. Repeated rows are scored each; an empty table
    stays one; other columns stay, those named as a result are replaced."""
    return docs.withColumn("score", score_column(text_of(docs), model)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Trees, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` that score `threshold` or more. Null texts are judged as empty ones,
    repeated rows each; an empty table stays one; all columns stay."""
    return docs.where(score_column(text_of(docs), model) >= threshold)
