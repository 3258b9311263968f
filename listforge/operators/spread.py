"""Join of many rows with one row per key, where a key may hold a large share of the rows."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key handled by one slice, and the longest list of hot keys that is broadcast.
SLICE_ROWS = 200_000
BROADCAST_KEYS = 100_000


def spread_join(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], row_id: str,
                counted: DataFrame | None = None, slice_rows: int = SLICE_ROWS, small: bool = False) -> DataFrame:
    """Left join of ``rows`` with ``per_key`` (at most one row per key) that splits hot keys.

    Keys with more than ``slice_rows`` rows get several slices: their rows are dealt out by
    a hash of ``row_id`` and their one partner row is copied per slice. There are at most rows / ``slice_rows``
    hot keys; up to BROADCAST_KEYS their list is broadcast, beyond that it is joined like any other
    table. Keys are counted on ``counted`` where ``rows`` is a wider version of it. A ``small`` partner table goes
    to every task instead, and ``rows`` stay where they are.
    """
    keys = list(keys)
    if small:
        return rows.join(F.broadcast(per_key), keys, "left")
    counted = rows if counted is None else counted
    counts = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > slice_rows).select(*keys, F.ceil(F.col("_n") / slice_rows).cast("int").alias("_slices"))
    if counted.count() // slice_rows <= BROADCAST_KEYS:
        hot = F.broadcast(hot)

    def sliced(df):
        return df.join(hot, keys, "left").withColumn("_slices", F.coalesce("_slices", F.lit(1)))

    left = sliced(rows).withColumn("_slice", F.pmod(F.xxhash64(row_id), F.col("_slices")).cast("int"))
    right = sliced(per_key).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    return left.drop("_slices").join(right.drop("_slices"), [*keys, "_slice"], "left").drop("_slice")
