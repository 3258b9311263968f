"""Quality rules as a short-circuit cascade.

Each rule needs some statistics of a document and rejects it or passes it on. On a sample every rule's cost (time per
document) and the sets of documents that it rejects are measured; rules then run in the order of most
rejections per cost among the documents still alive, and later rules never see what an earlier one rejected.
"""

import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, SPACES, _hash_words, mix

#: Rows, about, that costs and selectivities are estimated on; verdicts do not depend on them.
SAMPLE = 2000
#: Words of a window that counts as repeated when a text holds it twice.
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_BLANK = bytes(SPACES)


def _marked(marks: bytes | list[int] | range) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(marks)] = 1
    return out


_IS_SYMBOL = _marked(SYMBOLS)
#: First bytes of the code points of words.
_IS_CHAR = 1 - _marked([*SPACES, *range(0x80, 0xC0)])
_IS_UPPER = _marked(range(ord("A"), ord("Z") + 1))
_IS_LETTER = _marked([*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)])


def pieces(raw: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes, cut at white space only."""
    at = 0
    while at < len(raw):
        cut = _GAP.search(raw, at + size)
        end = cut.start() if cut else len(raw)
        yield raw[at:end]
        at = end


def _together(texts: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of CHUNK_BYTES together; a longer text stands alone."""
    i = 0
    while i < len(texts):
        j, total = i + 1, len(texts[i])
        while j < len(texts) and total + len(texts[j]) < CHUNK_BYTES:
            total += len(texts[j]) + 1
            j += 1
        yield i, j
        i = j


def _counted(texts: Sequence[bytes], marks: np.ndarray) -> np.ndarray:
    """Marked bytes of each text."""
    out = np.zeros(len(texts), np.int64)
    for i, j in _together(texts):
        if j == i + 1:
            out[i] = sum(int(marks[np.frombuffer(p, np.uint8)].sum()) for p in pieces(texts[i]))
            continue
        ends = np.cumsum([len(t) for t in texts[i:j]])
        sums = np.r_[0, np.cumsum(marks[np.frombuffer(b"".join(texts[i:j]), np.uint8)])]
        out[i:j] = sums[ends] - sums[np.r_[0, ends[:-1]]]
    return out


def _hashed(texts: Sequence[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Hashes of the words of some texts together: first text, hashes, number of the text from there."""
    for i, j in _together(texts):
        if j == i + 1:
            found = [_hash_words(np.frombuffer(p, np.uint8))[0] for p in pieces(texts[i])]
            words = np.concatenate(found) if found else np.empty(0, np.uint64)
            yield i, words, np.zeros(len(words), np.int64)
            continue
        words, ends = _hash_words(np.frombuffer(b" ".join(texts[i:j]), np.uint8))
        yield i, words, np.searchsorted(np.cumsum([len(t) + 1 for t in texts[i:j]]), ends, side="left")


def n_words(texts: Sequence[bytes]) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    for at, _, owner in _hashed(texts):
        found = np.bincount(owner)
        out[at : at + len(found)] += found
    return out


def n_repeat_words(texts: Sequence[bytes]) -> np.ndarray:
    """Words inside windows of WINDOW words that a text holds twice or more."""
    out = np.zeros(len(texts), np.int64)
    for at, words, owner in _hashed(texts):
        n = len(words) - WINDOW + 1
        if n < 2:
            continue
        h = owner[:n].astype(np.uint64)
        for k in range(WINDOW):
            h = h * np.uint64(0xC2B2AE3D27D4EB4F) + words[k : n + k]
        whole = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
        h = mix(h[whole])
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(len(whole), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        step = np.zeros(len(words) + 1, np.int64)
        step[whole[twice]] += 1
        step[whole[twice] + WINDOW] -= 1
        found = np.bincount(owner[np.cumsum(step[:-1]) > 0])
        out[at : at + len(found)] += found
    return out


def _lines(text: bytes) -> list[bytes]:
    return [line for line in text.split(b"\n") if line.strip(_BLANK)]


def n_lines(texts: Sequence[bytes]) -> np.ndarray:
    return np.array([len(_lines(t)) for t in texts], np.int64)


def n_dup_lines(texts: Sequence[bytes]) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    return np.array([len(found) - len(set(found)) for found in map(_lines, texts)], np.int64)


STATISTICS: dict[str, Callable[[Sequence[bytes]], np.ndarray]] = {
    "n_words": n_words,
    "word_chars": lambda texts: _counted(texts, _IS_CHAR),
    "n_symbols": lambda texts: _counted(texts, _IS_SYMBOL),
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
    "n_lines": n_lines,
    "n_letters": lambda texts: _counted(texts, _IS_LETTER),
    "n_upper": lambda texts: _counted(texts, _IS_UPPER),
}


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    fails: Callable[..., np.ndarray]  # of the needed statistics, in that order


#: The verdict's rules; their order here does not matter. Both base rules are among them.
RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 20),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 30 * n),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 10 * d > 4 * n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 15 * n)),
    Rule("few_letters", ("n_letters", "word_chars"), lambda a, c: 2 * a < c),
    Rule("shouting", ("n_upper", "n_letters"), lambda u, a: 2 * u > a),
)
BASE = ("few_words", "repeated_words")
BASE_STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Measured:
    """Statistics of a batch of texts, each computed once and only for the texts asked for."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.values: dict[str, np.ndarray] = {}
        self.known: dict[str, np.ndarray] = {}

    def __call__(self, name: str, rows: np.ndarray) -> np.ndarray:
        if name not in self.values:
            self.values[name], self.known[name] = np.zeros(len(self.texts), np.int64), np.zeros(len(self.texts), bool)
        new = rows[~self.known[name][rows]]
        if len(new):
            self.values[name][new] = STATISTICS[name]([self.texts[i] for i in new])
            self.known[name][new] = True
        return self.values[name][rows]


def cascade(measured: Measured, rules: Sequence[Rule]) -> np.ndarray:
    """Number of the first rule that rejects each text, -1 where all pass; rejected texts reach no later rule."""
    verdict = np.full(len(measured.texts), -1)
    alive = np.arange(len(measured.texts))
    for i, rule in enumerate(rules):
        if not len(alive):
            break
        failed = rule.fails(*[measured(name, alive) for name in rule.needs])
        verdict[alive[failed]] = i
        alive = alive[~failed]
    return verdict


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and texts of a batch in groups of some megabytes."""
    texts = batch.column("text").cast(pa.binary())
    first, held, group = 0, 0, []
    for i, text in enumerate(texts):
        group.append(text.as_py() or b"")
        held += len(group[-1])
        if held >= 4 * CHUNK_BYTES or i == batch.num_rows - 1:
            yield batch.column("doc_id").slice(first, len(group)), group
            first, held, group = i + 1, 0, []


def _trial(rules: Sequence[Rule]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _groups(batch):
                every = np.arange(len(texts))
                rejected, spent = np.zeros(len(texts), np.int64), []
                for i, rule in enumerate(rules):
                    alone, start = Measured(texts), time.perf_counter()
                    failed = rule.fails(*[alone(name, every) for name in rule.needs])
                    spent.append(time.perf_counter() - start)
                    rejected[failed] |= 1 << i
                sets, n = np.unique(rejected, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sets, pa.int64()), pa.array(n, pa.int64()), pa.array([spent] + [[0.0] * len(rules)] * (len(sets) - 1), pa.list_(pa.float64()))],
                    names=["rejected", "n", "seconds"])
    return run


def order(docs: DataFrame, rules: Sequence[Rule] = RULES, rows: int = SAMPLE) -> list[Rule]:
    """Rules by most rejections per cost among what the earlier ones leave, estimated on about ``rows`` documents.

    The driver sees one row per set of rules that some sampled document fails. Rules that reject nothing in the sample
    come last, the cheapest first; without documents the given order stays.
    """
    total = docs.count()
    share = 1 << 30
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if total > rows:
        sample = sample.filter(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(share)) < int(share * rows / total))
    n = len(rules)
    found = (sample.mapInArrow(_trial(rules), "rejected long, n long, seconds array<double>")
             .groupBy("rejected").agg(F.sum("n").alias("n"), *[F.sum(F.col("seconds")[i]).alias(f"s{i}") for i in range(n)]).collect())
    cost = [sum(r[f"s{i}"] for r in found) for i in range(n)]
    left, chosen = {r["rejected"]: r["n"] for r in found}, []
    while len(chosen) < n:
        def worth(i: int) -> tuple:
            gone = sum(k for sets, k in left.items() if sets >> i & 1)
            return -gone / max(cost[i], 1e-9), cost[i], i
        best = min((i for i in range(n) if i not in chosen), key=worth)
        chosen.append(best)
        left = {sets: k for sets, k in left.items() if not sets >> best & 1}
    return [rules[i] for i in chosen]


def judge(docs: DataFrame, rules: Sequence[Rule], statistics: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, ``statistics``, rejected_by (first rejecting rule of the given order, null if kept).

    Whole texts are read. A null or empty text has zeros everywhere. Statistics asked for are computed for rejected rows as well, all
    others only as far as the cascade gets. Rows that repeat an id and null ids are judged each for itself, an empty
    table gives an empty one, and columns other than doc_id and text are not read, whatever their names.
    """
    names = [rule.name for rule in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _groups(batch):
                measured = Measured(texts)
                verdict = cascade(measured, rules)
                every = np.arange(len(texts))
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array(measured(s, every), pa.int64()) for s in statistics], pa.array([names[v] if v >= 0 else None for v in verdict], pa.string())],
                    names=["doc_id", *statistics, "rejected_by"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {''.join(f'{s} long, ' for s in statistics)}rejected_by string")


def kept(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that pass every rule, with all their columns; of an id that repeats, all rows or none (rows without an id never)."""
    good = judge(docs, order(docs, rules)).groupBy("doc_id").agg(F.count("rejected_by").alias("_bad")).filter("_bad = 0").select(F.col("doc_id").alias("_good"))
    return docs.join(good, docs["doc_id"] == good["_good"], "left_semi")
