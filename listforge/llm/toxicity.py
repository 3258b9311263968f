"""Toxicity score: a factorization machine over hashed terms."""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, labelled_texts

#: Labelled rows that the model is fitted on, at most about so many.
SAMPLE = 30_000
#: Terms kept for a signal of their own and for one beside others, and the least chi-square and documents of a term.
TERMS, BESIDE, CHI_SQUARE, DOCUMENTS = 4096, 4096, 25.0, 5
#: Strongest signs of toxicity, beside which the other terms are counted again, and the chi-square that they need there.
SIGNS, BESIDE_CHI_SQUARE = 256, 15.0
FACTORS, EPOCHS, BATCH, RATE, DECAY, SEED = 8, 20, 256, 0.05, 1e-5, 11
#: Beginnings of words that are terms besides the words, so that inflected forms meet.
STEMS = (4, 5, 6)
_EDGES = ".,;:!?|*#$%&()[]{}<>\"'`~^+=/\\_-"
#: Words whose terms a task remembers, about 25 MB.
_MEMORY = 100_000


def word_terms(word: str) -> list[int]:
    """Hashed terms (unsigned 32 bits) of one lower-cased word."""
    word = word.strip(_EDGES)
    if not word:
        return []
    return [zlib.crc32(f"w {word}".encode())] + [zlib.crc32(f"{n} {word[:n]}".encode()) for n in STEMS if len(word) > n]


class _Terms:
    """Terms of texts, restricted to ``index`` (term to number) if one is given."""

    def __init__(self, index: dict[int, int] | None = None):
        self.index, self.known = index, {}

    def __call__(self, text: str) -> set[int]:
        out: set[int] = set()
        known, index = self.known, self.index
        for word in set(text.lower().split()):
            terms = known.get(word)
            if terms is None:
                terms = word_terms(word)
                if index is not None:
                    terms = [index[t] for t in terms if t in index]
                if len(known) >= _MEMORY:
                    known.clear()
                known[word] = terms
            if terms:
                out.update(terms)
        return out


@dataclass
class Model:
    terms: np.ndarray  # sorted hashed terms
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        """Linear part plus all pairwise interactions, through sums of factors."""
        sizes = np.array([len(r) for r in rows])
        at = np.concatenate(rows).astype(np.int64) if sizes.sum() else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(rows)), sizes)
        out = self.bias + np.bincount(owner, self.weights[at], len(rows))
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            out += 0.5 * (np.bincount(owner, v, len(rows)) ** 2 - np.bincount(owner, v * v, len(rows)))
        return out

    def scores(self, texts: list[str], terms: "_Terms") -> np.ndarray:
        rows = [np.fromiter(sorted(terms(t)), np.int64) for t in texts]
        return 1 / (1 + np.exp(-np.clip(self.logits(rows), -30, 30)))

    def index(self) -> dict[int, int]:
        return {int(t): i for i, t in enumerate(self.terms)}


def _fit(terms: np.ndarray, rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Adam on the logistic loss, with decay; rows hold term numbers."""
    rng = np.random.default_rng(SEED)
    n = len(terms)
    rate = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 1e-9
    model = Model(terms, float(np.log(rate / (1 - rate))), np.zeros(n), rng.normal(0, 0.01, (n, FACTORS)))
    if not n:
        return model
    theta = [model.weights, model.factors]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in theta]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            sizes = np.array([len(rows[i]) for i in part])
            if not sizes.sum():
                continue
            cols = np.concatenate([rows[i] for i in part])
            owner = np.repeat(np.arange(len(part)), sizes)
            v = model.factors[cols]
            sums = np.zeros((len(part), FACTORS))
            np.add.at(sums, owner, v)
            logit = model.bias + np.bincount(owner, model.weights[cols], len(part)) + 0.5 * ((sums**2).sum(1) - np.bincount(owner, (v * v).sum(1), len(part)))
            error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[part]
            g_w = np.bincount(cols, error[owner], n) / len(part)
            g_v = np.zeros_like(model.factors)
            np.add.at(g_v, cols, error[owner][:, None] * (sums[owner] - v) / len(part))
            step += 1
            rate_now = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
            model.bias -= rate_now * float(error.mean())
            for p, g, (m, s) in zip(theta, (g_w, g_v), moments, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate_now * ((m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8) + DECAY * p)
    return model


def _counts(signs: frozenset[int] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with each term, all and positive, of one partition; with ``signs`` of those documents that hold one. Term -1 counts them all."""
        terms, n, positive = _Terms(), {}, {}
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                found = terms(text)
                if signs is not None and signs.isdisjoint(found):
                    continue
                for t in (-1, *found):
                    n[t] = n.get(t, 0) + 1
                    if label:
                        positive[t] = positive.get(t, 0) + 1
        keys = list(n)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([n[t] for t in part], pa.int64()), pa.array([positive.get(t, 0) for t in part], pa.int64())], names=["term", "n", "positive"])
    return run


def _telling(sample: DataFrame, most: int, least: float, signs: frozenset[int] | None = None) -> list[tuple[int, bool]]:
    """The terms of the largest chi-square with the label, strongest first, and whether they stand for it; among documents with one of ``signs`` if given."""
    counted = keep(sample.mapInArrow(_counts(signs), "term bigint, n bigint, positive bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("positive").alias("k")), "terms")
    whole = counted.filter("term = -1").first()
    if whole is None or whole["k"] in (0, whole["n"]):
        return []
    total, positive = whole["n"], whole["k"]
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    gap = k * (total - n - (positive - k)) - (n - k) * (positive - k)
    chi = total * gap * gap / (n * (total - n) * positive * (total - positive))
    best = counted.filter((F.col("term") >= 0) & (F.col("n") >= DOCUMENTS) & (F.col("n") < total)).withColumn("_chi", chi).withColumn("_for", gap > 0).filter(F.col("_chi") >= least)
    return [(r["term"], r["_for"]) for r in best.orderBy(F.desc("_chi"), "term").limit(most).select("term", "_for").collect()]


def _numbered(index: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(index)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([sorted(terms(t)) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], names=["label", "terms"])
    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """Fit on at most about ``rows`` labelled documents, none of them held out.

    Terms are chosen by the chi-square of their presence with the label, counted by Spark: first over the whole sample, then among
    the documents that hold one of the strongest signs. The second count finds words that tell nothing alone and
    something beside a sign, such as the mention of a group beside an insult; the machine learns the pairs. Only
    the chosen terms' numbers of each sampled document come to the driver. Without labelled rows
    the score is about 0 everywhere; with one class only it is that class's (clipped) share. A label counts once for each row
    of its id; the sample's bound is on labels.
    """
    sample = keep(labelled_texts(docs, labels, "toxic", rows), "toxic-sample")
    total, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    empty = np.empty(0, np.int64)
    if not total or positive in (0, total):
        return _fit(empty, [], np.full(min(total, 1), float(positive > 0)))
    alone = _telling(sample, TERMS, CHI_SQUARE)
    signs = frozenset([t for t, toxic in alone if toxic][:SIGNS])
    beside = _telling(sample, BESIDE, BESIDE_CHI_SQUARE, signs) if signs else []
    terms = np.array(sorted({t for t, _ in [*alone, *beside]}), dtype=np.int64)
    index = {int(t): i for i, t in enumerate(terms)}
    known = sample.mapInArrow(_numbered(index), "label int, terms array<int>").collect()
    known = sorted((r["label"], r["terms"]) for r in known)  # the same order at each run
    return _fit(terms, [np.array(t, np.int64) for _, t in known], np.array([y for y, _ in known], float))


def score(model: Model, text: Column) -> Column:
    """Probability of toxicity for a text column (null counts as empty)."""

    @F.pandas_udf("double")
    def toxic(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = _Terms(model.index())
        for part in parts:
            yield pd.Series(np.concatenate([model.scores(part.iloc[i : i + 2000].tolist(), terms) for i in range(0, len(part), 2000)]) if len(part) else [], dtype="float64")

    return toxic(F.coalesce(text, F.lit("")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without rows scored at ``threshold`` or more; columns unchanged, no shuffle."""
    return docs.filter(score(train(docs, labels), docs["text"]) < threshold)
