"""Sharding: minimax contiguous partition of ordered groups of equal texts."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, ordered_totals

SHARDS = 8
#: Capacities tried at once; a round leaves one in so many of those still possible.
TRIALS = 256


def _nearest(ends: DataFrame, marks: np.ndarray, above: bool) -> np.ndarray:
    """For each mark the largest group end at or below it (0 if none), or with ``above`` the smallest at or above."""
    marks = np.asarray(marks, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.full(len(marks), np.iinfo(np.int64).max if above else 0)
        for batch in batches:
            own = np.sort(batch.column("end").to_numpy())
            if above:
                at = np.searchsorted(own, marks, side="left")
                found = np.minimum(found, np.r_[own, np.iinfo(np.int64).max][at])
            else:
                at = np.searchsorted(own, marks, side="right")
                found = np.maximum(found, np.r_[0, own][at])
        # Each task says something about each mark, so the number of marks is kept small.
        new = found != (np.iinfo(np.int64).max if above else 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(new), pa.int32()), pa.array(found[new], pa.int64())], names=["mark", "end"])

    best = (F.min if above else F.max)("end").alias("end")
    got = ends.select("end").mapInArrow(run, "mark int, end bigint").groupBy("mark").agg(best).collect()
    out = np.full(len(marks), np.iinfo(np.int64).max if above else 0)
    for mark, end in got:
        out[mark] = end
    return out


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity that ``shards`` contiguous shards need, and the ends of all shards but the last.

    ``ends`` holds the running total at the end of each group. A capacity is feasible if filling each shard
    greedily leaves at most a capacity for the last. The search keeps the bracket of a binary search
    but tries TRIALS capacities per pass, since each step of the greedy check reads ``ends`` once.
    """
    low = max(-(-total // shards), largest)
    high = -(-total // shards) + largest  # each greedy shard is then at least a mean shard
    while low < high:
        tried = np.unique(np.linspace(low, high, min(TRIALS, high - low + 1)).astype(np.int64))
        at = np.zeros(len(tried), np.int64)
        for _ in range(shards - 1):
            at = _nearest(ends, at + tried, above=False)
        fits = np.flatnonzero(total - at <= tried)
        first = int(fits[0]) if len(fits) else len(tried) - 1
        low, high = (int(tried[first - 1]) + 1 if first else low), int(tried[first])
    # Any cuts between the greedy ones from the left and from the right keep the capacity: take those nearest equal parts.
    late = [total]
    for _ in range(shards - 1):
        late.append(int(_nearest(ends, np.array([late[-1] - high]), above=True)[0]) if late[-1] > high else 0)
    late = late[1:][::-1]
    cuts, at = [], 0
    for j in range(shards - 1):
        goal = at + (total - at) // (shards - j)
        below, over = (int(_nearest(ends, np.array([goal]), above=x)[0]) for x in (False, True))
        cut = over if over - goal < goal - below else below
        if cut < late[j]:
            cut = late[j]
        if cut > at + high:
            cut = int(_nearest(ends, np.array([at + high]), above=False)[0])
        at = max(at, cut)
        cuts.append(at)
    return high, cuts


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, mark, size, text_crc32, shard, slot.

    A size is the text's UTF-8 bytes plus 1 (null: 1). Documents stand in the order of their text's hash and then
    id, so that equal texts (null counts as empty) are neighbours and make one atomic group; two texts
    with one hash would merely travel together. The groups are cut into contiguous shards whose
    largest one is as small as it can be. Slots count from 0 in each shard. There may be fewer groups than
    shards; an empty table gives an empty result. Repeated rows take a slot each.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"], F.xxhash64(text).alias("mark"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.lit(1).alias("_one"))
    placed = keep(ordered_totals(rows, [], ["mark", "doc_id"], {"_bytes": "size", "_rows": "_one"}), "sized")
    groups = keep(placed.groupBy("mark").agg(F.max(F.col("_bytes") + F.col("size")).alias("end"), F.sum("size").alias("_size")), "groups")
    total, largest = groups.agg(F.coalesce(F.max("end"), F.lit(0)), F.coalesce(F.max("_size"), F.lit(0))).first()
    cuts = minimax_cuts(groups, total, largest, shards)[1] if total else []
    number = F.lit(0)
    for cut in cuts:
        number = number + F.when(F.col("_bytes") >= cut, 1).otherwise(0)
    before = placed.agg(*[F.coalesce(F.sum(F.when(F.col("_bytes") < cut, 1)), F.lit(0)) for cut in cuts]).first() if cuts else []
    first = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in (0, *before)]), F.col("shard") + 1)
    return placed.withColumn("shard", number.cast("int")).select("doc_id", "mark", "size", "text_crc32", "shard", (F.col("_rows") - first).alias("slot"))
