"""Importance resampling towards a target distribution, over hashed word runs.

An untrained ``Split`` of the tokenizers library cuts ASCII-lowered texts into words with offsets; every pair of offsets
that spans one to three words is a feature, hashed into a bucket. Bucket histograms of all documents and of the
target texts give each bucket a gain, a document weighs the gains of its features, and Gumbel noise from the id
turns the largest scores into a weighted draw without replacement.
"""

import re
import zlib
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from ..sources.shared import keep
from .common import CHUNK_BYTES, ordered_totals

#: Words of ASCII-lowered text, and the ASCII bytes between them.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Words of the longest feature.
RUN = 3
BUCKETS = 10_000
#: Documents with fewer words are weighed and never drawn.
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Bytes of bucket numbers that one output batch holds, about.
BATCH_BYTES = 8 << 20


def pieces(raw: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """A lowered text in pieces of about ``size`` bytes, cut between words only."""
    at = 0
    while at < len(raw):
        cut = _BETWEEN.search(raw, at + size)
        end = cut.start() if cut else len(raw)
        yield raw[at:end]
        at = end


class Features:
    """Buckets of the features of whole texts; made in the Python worker."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.split = pre_tokenizers.Split(Regex(WORDS), behavior="removed", invert=True)

    def __call__(self, text: bytes) -> tuple[int, np.ndarray]:
        """Number of words, and one bucket per feature, repeats included."""
        crc, n_words, out = zlib.crc32, 0, []
        carried: list[bytes] = []  # the words before this piece that its first features begin with
        for piece in pieces(text.lower()):
            found = self.split.pre_tokenize_str(piece.decode("utf-8", "replace"))
            if not found:
                continue
            n_words += len(found)
            words = carried + [word.encode() for word, _ in found]
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.r_[0, ends[:-1] + 1].tolist()
            ends = ends.tolist()
            for width in range(1, RUN + 1):
                first = max(0, len(carried) - width + 1)
                out.append(np.fromiter((crc(line[a:b]) for a, b in zip(starts[first:], ends[first + width - 1 :], strict=False)), np.uint32) % self.buckets)
            carried = words[-(RUN - 1) :]
        return n_words, np.concatenate(out).astype("<u4") if out else np.empty(0, "<u4")


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for text in batch.column("text").cast(pa.binary()):
        yield text.as_py() or b""


def _featured(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        kind = "<u2" if buckets <= 1 << 16 else "<u4"
        for batch in batches:
            rows, held, first = [], 0, 0
            for i, text in enumerate(_texts(batch)):
                n_words, found = features(text)
                rows.append((n_words, len(found), found.astype(kind).tobytes()))
                held += len(rows[-1][2])
                if held >= BATCH_BYTES or i == batch.num_rows - 1:
                    n_words, n_features, numbers = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(first, len(rows)), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(numbers, pa.binary())],
                        names=["doc_id", "n_words", "n_features", "buckets"])
                    rows, held, first = [], 0, i + 1
    return run


def _bucket_numbers(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All bucket numbers of a batch in one array, and the number of them per row."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    values = [v.as_buffer() for v in column]
    return np.frombuffer(b"".join(values), kind), np.array([len(v) // kind.itemsize for v in values], np.int64)


def featured(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Kept columns doc_id, n_words, n_features, buckets (little-endian numbers, repeats included) of every row; null texts have none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keep(rows.mapInArrow(_featured(buckets), "doc_id long, n_words long, n_features long, buckets binary"), "features")


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows per bucket: each task adds up its own, the driver sees one number per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_bucket_numbers(batch.column("buckets"), buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    found = rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in found:
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, per bucket."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([floor(1000 * log(float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, lengths = _bucket_numbers(batch.column("buckets"), len(gain))
            sums = np.r_[0, np.cumsum(gain[numbers])]
            ends = np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(sums[ends] - sums[ends - lengths], pa.int64())],
                names=["doc_id", "n_words", "n_features", "weight"])
    return run


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) weighed against the texts of ``target``: doc_id, n_words, n_features, weight, score, rank.

    Of the rows with ``least_words`` words, ``percent`` of a hundred (rounded down) are drawn by the highest scores, ties to the
    smaller doc_id; their rank counts from 1, that of all others is null. Whole texts are read, in pieces.
    A null text has no words, no features and weight 0. Rows that repeat an id have the same noise, count each for itself
    and rank in the order in which they are stored; null ids share the noise of the empty id and rank after others
    of their score. Empty documents give an empty table; without target texts all its counts are 0. Other
    columns are not read, whatever their names.
    """
    rows = featured(docs, buckets)
    aims = featured(target.select(F.lit(0).alias("doc_id"), "text"), buckets)
    gain = gains(histogram(rows, buckets), histogram(aims, buckets))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((noise + F.lit(0.5)) / F.lit(4294967296.0))))
    weighed = rows.mapInArrow(_weighed(gain), "doc_id long, n_words long, n_features long, weight long")
    # The number of the stored row ends every tie, so that repeated rows spread over the ranges of the sort.
    weighed = keep(weighed.withColumn("score", score.cast("long")).withColumn("_row", F.monotonically_increasing_id()), "weights")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    able = weighed.filter(F.col("n_words") >= least_words).withColumn("_one", F.lit(1))
    drawn = able.count() * percent // 100
    if not drawn:
        return weighed.select(*columns, F.lit(None).cast("long").alias("rank"))
    ranked = ordered_totals(able, [], [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")], {"_before": "_one"})
    rank = F.when(F.col("_before") < drawn, F.col("_before") + 1)
    return ranked.select(*columns, rank.alias("rank")).union(weighed.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long")))


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with all their columns; every row of a drawn id stays, rows without an id do not."""
    ids = keep(resample(docs, target, **options).filter("rank is not null and doc_id is not null").select(F.col("doc_id").alias("_drawn")).distinct(), "drawn")
    return docs.join(ids, docs["doc_id"] == ids["_drawn"], "left_semi")
