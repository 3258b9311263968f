"""Best rows per key, safe for keys of any size."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Slices of a key, at least.
SLICES = 64


def _best(df: DataFrame, keys: Sequence[str], k: int, pos: str) -> DataFrame:
    within = Window.partitionBy(*keys).orderBy(F.col("rating").desc(), "id")
    return (
        df.withColumn(pos, F.dense_rank().over(within))
        .filter(F.col(pos) <= k)
        # A listing may reach a key on several ways; its copies tie in rank and stand side by side.
        .withColumn("_previous", F.lag("id").over(within))
        .filter(F.col("_previous").isNull() | (F.col("_previous") != F.col("id")))
        .drop("_previous")
    )


def best_per_key(df: DataFrame, keys: Sequence[str], k: int, pos: str = "pos") -> DataFrame:
    """The ``k`` best distinct listings per key: rating descending, then id.

    Every map task cuts its keys to ``k`` before the shuffle (WindowGroupLimit), so a
    key brings at most ``k`` rows per map task to its reducer, however many it has.
    """
    return _best(df, keys, k, pos)


def best_per_hot_key(df: DataFrame, keys: Sequence[str], k: int, pos: str = "pos") -> DataFrame:
    """The same in two rounds, for a whole catalog with very many map tasks.

    The first round merges slices of each key (by input partition, which leaves the map-side cut
    as strong as before) on many reducers; the second sees at most ``k`` rows a slice and key.
    """
    # A cluster set up for more reducers has more map tasks as well.
    slices = max(SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    sliced = df.withColumn("_slice", F.spark_partition_id() % slices)
    return _best(_best(sliced, [*keys, "_slice"], k, pos).drop("_slice", pos), keys, k, pos)


def contending(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Sorted lists that can hold one of the ``k`` best rows of a key, given each list's best row.

    Fewer than ``k`` distinct rows may come before a list's best one; a row at the head of several
    lists counts once.
    """
    within = Window.partitionBy(*keys).orderBy(F.col("rating").desc(), "id")
    return df.withColumn("_rank", F.dense_rank().over(within)).filter(F.col("_rank") <= k).drop("_rank")
