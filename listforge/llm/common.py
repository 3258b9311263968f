"""What several operators share: kept stages, ordered running totals, word shingles, hashed labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import keep

#: Rows up to which a list of ids is broadcast (16 MB of longs); longer lists are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that one numpy step works on, so memory does not follow the Arrow batch.
CHUNK_BYTES = 1 << 20
#: Bytes of text whose words are hashed at once; each byte takes some 50 in between.
HASH_BYTES = 1 << 18
#: Rows and bytes, at most, of an Arrow batch on its way to Python. Spark's own 10,000 rows hold as much as their texts are long, in the
#: executor and in its Python worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
#: White space between words, the same bytes in every operator.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_batches(spark: SparkSession) -> dict[str, str]:
    """Hold the session's Arrow batches to BATCHES from now on, where they may be larger; what held before."""
    before = {}
    for name, most in BATCHES.items():
        now = spark.conf.get(name)
        if not now.isdigit() or not 0 < int(now) <= most:
            before[name] = now
            spark.conf.set(name, str(most))
    return before


@contextmanager
def narrow_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCHES for what runs inside the block."""
    before = lower_batches(spark)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def semi_by(df: DataFrame, column: str, wanted: DataFrame, rows: int) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in the one-column table ``wanted`` (null equals null).

    ``wanted`` has ``rows`` rows; up to BROADCAST_ROWS it is broadcast, beyond that both
    sides are shuffled.
    """
    right = wanted.toDF("_wanted").distinct()
    if rows <= BROADCAST_ROWS:
        right = F.broadcast(right)
    return df.join(right, df[column].eqNullSafe(right["_wanted"]), "left_semi")


def ordered_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], totals: dict[str, str]) -> DataFrame:
    """Kept rows of ``df`` with running totals before each row, per ``keys``, in ``order``.

    ``totals`` maps new long columns to numeric ones. Rows are dealt out by ranges of (keys, order),
    so a key with a third of all rows covers many partitions; each task adds up its own
    rows and only one row per (partition, key) is added up across tasks. The scan position ends the order,
    so rows that are equal in it, such as a repeated one, are dealt out as well.
    """
    keys = list(keys)
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    spread = tied.repartitionByRange(*[F.col(k) for k in keys], *order, "_tie").sortWithinPartitions(*keys, *order, "_tie").drop("_tie")
    # Written before it is numbered: a second evaluation could draw the ranges elsewhere.
    kept = keep(spread.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    sums = [F.sum(c).alias(f"_sum{i}") for i, c in enumerate(totals.values())]
    parts = kept.groupBy("_part", *keys).agg(*sums)
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
                         *[F.coalesce(F.sum(f"_sum{i}").over(earlier), F.lit(0)).alias(f"_before{i}") for i in range(len(totals))])
    same = kept["_part"] == parts["_part"]
    for i, k in enumerate(keys):
        same = same & kept[k].eqNullSafe(parts[f"_key{i}"])
    local = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    run = kept.select(*kept.columns, *[F.coalesce(F.sum(c).over(local), F.lit(0)).alias(f"_local{i}") for i, c in enumerate(totals.values())])
    same = run["_part"] == parts["_part"]
    for i, k in enumerate(keys):
        same = same & run[k].eqNullSafe(parts[f"_key{i}"])
    return run.join(parts, same).select(
        *[run[c] for c in df.columns], *[(F.col(f"_before{i}") + F.col(f"_local{i}")).cast("long").alias(name) for i, name in enumerate(totals)])


# -- word shingles --

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_P = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(n, HASH_BYTES).bit_length()
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, dtype=np.uint64)]) for x in (_P, pow(_P, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose result bits depend on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and end positions of the words in lower-cased bytes."""
    space = _IS_SPACE[raw]
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(raw) + 1)
    run = np.empty(len(raw) + 1, dtype=np.uint64)
    run[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=run[1:])
    h = (run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h), end


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash for each word of one text, A-Z lower-cased. Long texts are read in pieces cut at white space."""
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + HASH_BYTES)
        if end < len(raw):
            cut = max(raw.rfind(s, at, end) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            while cut <= at and end < len(raw):  # a word longer than the piece
                end = min(len(raw), end + HASH_BYTES)
                cut = max(raw.rfind(s, at + 1, end) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            end = cut if cut > at and end < len(raw) else end
        out.append(_hash_words(_LOWER[np.frombuffer(raw, np.uint8, end - at, at)])[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the word sequences of ``size``; fewer words make one shingle."""
    n = len(words)
    width = min(size, n)
    h = np.full(max(0, n - width + 1) if n else 0, width, dtype=np.uint64)
    for j in range(width):
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : n - width + 1 + j]
    return mix(h)


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes (int64) of its shingles."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) < HASH_BYTES):
            total += len(texts[j]) + 1
            j += 1
        if j == i + 1:
            groups = [word_hashes(texts[i])]
        else:  # many short texts at once, a space between them
            raw = np.frombuffer(b" ".join(texts[i:j]), np.uint8)
            h, ends = _hash_words(_LOWER[raw])
            limits = np.cumsum([len(t) + 1 for t in texts[i:j]])
            groups = np.split(h, np.searchsorted(ends, limits[:-1], side="left"))
        for k, words in enumerate(groups):
            s = np.sort(_shingles(words, size).view(np.int64))
            out[i + k] = s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s
        i = j
    return out


# -- labelled rows --

def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod 5 is 0 are never learned from; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most about ``rows`` labelled texts to learn from, chosen by a hash of the id: columns text, label.

    Labels other than 0 and 1, contradicting labels of one id and held-out rows are left out.
    """
    known = (labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
             .filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
             .groupBy("_id").agg(F.min("_label").alias("label"), F.max("_label").alias("_other"))
             .filter(F.col("label") == F.col("_other")).drop("_other"))
    known = keep(known, "labels")
    share = known.count()
    if share > rows:
        known = known.filter(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * rows / share))
        share = rows
    if share <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return docs.join(known, docs["doc_id"] == known["_id"]).select(F.coalesce(docs["text"], F.lit("")).alias("text"), known["label"])
