"""Quality score: histogram gradient-boosted trees over document statistics."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, SPACES, labelled_texts

#: Labelled rows that the trees are fitted on, at most about so many.
SAMPLE = 30_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_ROWS = 80, 4, 64, 0.15, 1.0, 10

_CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "symbol", "high")
_KIND = np.full(256, 6, np.uint8)
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[list(SPACES)] = 3
_KIND[ord("\n")] = 4
_KIND[[ord(c) for c in ".,;:'\"-"]] = 5
_KIND[128:] = 7
STATISTICS = (*_CLASSES, "bytes", "words", "word_length", "distinct_words", "repeated_words", "top_word", "stops_per_line", "words_per_line",
              "distinct_lines", "upper_words", "symbol_words", "lone_symbols", "first_capital", "long_words", "short_words")


def statistics(text: str) -> list[float]:
    """Statistics of one whole text, in the order of STATISTICS; an empty text has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.zeros(8)
    for at in range(0, len(raw), CHUNK_BYTES):
        counts += np.bincount(_KIND[np.frombuffer(raw, np.uint8, min(CHUNK_BYTES, len(raw) - at), at)], minlength=8)
    n = max(1, len(raw))
    words = text.split()
    w = max(1, len(words))
    seen: dict[str, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    lines = [x for x in text.split("\n") if x]
    in_row = sum(map(str.__eq__, words[1:], words[:-1]))
    upper = symbol = lone = capital = long = short = 0
    for x, k in seen.items():
        if x.isupper() and len(x) > 1:
            upper += k
        if not x[-1].isalnum() and x[-1] not in ".,;:'\"-":
            symbol += k
        if len(x) == 1 and not x.isalnum():
            lone += k
        if x[0].isupper():
            capital += k
        if len(x) > 12:
            long += k
        elif len(x) < 4:
            short += k
    return [*(counts / n), float(len(raw)), float(len(words)), len(text) / w, len(seen) / w, in_row / w, max(seen.values(), default=0) / w,
            counts[5] / max(1, len(lines)), len(words) / max(1, len(lines)), len(set(lines)) / max(1, len(lines)),
            upper / w, symbol / w, lone / w, capital / w, long / w, short / w]


@dataclass
class Forest:
    """All trees flattened: node i of a tree has its children at 2i+1 and 2i+2; leaves pass on to themselves."""

    feature: np.ndarray  # (trees, nodes)
    threshold: np.ndarray
    value: np.ndarray  # (trees, leaves)
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost depth-DEPTH trees on the logistic loss; splits are found on histograms of at most BINS bins."""
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    bias = float(np.log(rate / (1 - rate)))
    none = Forest(np.zeros((0, 2**DEPTH - 1), np.int64), np.zeros((0, 2**DEPTH - 1)), np.zeros((0, 2**DEPTH)), bias)
    if len(y) < 2 * LEAST_ROWS or y.min() == y.max():
        return none
    n, columns = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(columns)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    margin = np.full(n, bias)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        node = np.zeros(n, np.int64)  # within the level
        for level in range(DEPTH):
            width = 2**level
            best = np.full(width, 1e-6)
            choice = np.full((width, 2), -1)
            sums = [np.bincount(node, v, width) for v in (g, h)]
            base = sums[0] ** 2 / (sums[1] + RIDGE)
            for j in range(columns):
                key = node * BINS + binned[:, j]
                gl, hl, nl = (np.cumsum(np.bincount(key, v, width * BINS).reshape(width, BINS), 1) for v in (g, h, np.ones(n)))
                gr, hr, nr = sums[0][:, None] - gl, sums[1][:, None] - hl, nl[:, -1:] - nl
                gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - base[:, None]
                gain[(nl < LEAST_ROWS) | (nr < LEAST_ROWS)] = -1
                gain[:, len(edges[j]) :] = -1
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                choice[better, 0], choice[better, 1] = j, top[better]
            right = np.zeros(n, np.int64)
            for k in range(width):
                j, cut = choice[k]
                if j >= 0:
                    feature[width - 1 + k], threshold[width - 1 + k] = j, edges[j][cut]
                    own = node == k
                    right[own] = binned[own, j] > cut
            node = 2 * node + right
        value = RATE * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + RIDGE)
        margin += value[node]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), bias)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Forest:
    """Fit on at most about ``rows`` labelled documents, none of them held out; only their statistics come to the driver.

    Without labelled rows every score is 0.5, with labels of one class it is that class's clipped share.
    """
    sample = labelled_texts(docs, labels, "quality", rows)
    known = sorted((r["label"], r["x"]) for r in sample.mapInArrow(_measured, "label int, x array<double>").collect())
    return fit(np.array([x for _, x in known]).reshape(len(known), len(STATISTICS)), np.array([y for y, _ in known], float))


def score(forest: Forest, text: Column) -> Column:
    """Probability of good quality for a text column (null counts as empty)."""

    @F.pandas_udf("double")
    def good(part: pd.Series) -> pd.Series:
        return pd.Series(forest.scores(np.array([statistics(t) for t in part]).reshape(len(part), len(STATISTICS))))

    return good(F.coalesce(text, F.lit("")))
