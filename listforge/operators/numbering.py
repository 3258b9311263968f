"""Consecutive numbers and running totals over a global order, without a one-task window."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import keep

# monotonically_increasing_id: partition number in the upper bits, row number in the lower 33.
_ROW_BITS = 33
_ROW_MASK = (1 << _ROW_BITS) - 1


def range_sorted(df: DataFrame, *order: Column | str) -> DataFrame:
    """Global sort by range partitions.

    The scan position ends the sort key: rows with equal keys are spread over as many
    range partitions as they need, so one key holding a third of the rows is no hot spot.
    """
    return df.withColumn("_scan", F.monotonically_increasing_id()).orderBy(*order, "_scan").drop("_scan")


def kept_in_order(df: DataFrame) -> DataFrame:
    """Write the rows as they stand with their position (``_seq``): partition, then row in it."""
    return keep(df.withColumn("_seq", F.monotonically_increasing_id()), "ordered")


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    return kept_in_order(range_sorted(df, *order))


def _offsets(ordered: DataFrame, weight: Column) -> DataFrame:
    """Total weight before each sort partition: one row per partition, whatever the data size."""
    totals = ordered.groupBy(F.shiftright("_seq", _ROW_BITS).alias("_part")).agg(F.sum(weight).alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))


def number(ordered: DataFrame, name: str, kind: str = "bigint") -> DataFrame:
    """Number the rows of :func:`kept_in_order` 1..n: offset of the partition plus row in it, no shuffle."""
    offsets = _offsets(ordered, F.lit(1))
    row = F.col("_seq").bitwiseAND(F.lit(_ROW_MASK))
    return (
        ordered.withColumn("_part", F.shiftright("_seq", _ROW_BITS))
        # Bounded by the number of sort partitions.
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + row + 1).cast(kind))
        .drop("_part", "_seq", "_before")
    )


def number_in_files(df: DataFrame, file: str, row: str, name: str) -> DataFrame:
    """Number rows 1..n by file path and row number (from 0) in the file.

    ``df`` should be a kept table, it is read twice. Where every file is whole, the rows before the file and the
    row number give the id without a sort. Where rows are missing, as after a filter, the rows
    are sorted by (file, row) and numbered.
    """
    counts = df.groupBy(file).agg(F.count(F.lit(1)).alias("_n"), F.max(row).alias("_last"))
    if not counts.filter("_n <> _last + 1").isEmpty():
        return number_rows(df, file, row, name=name)
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(file, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # One row per file with its path: many files make this too large to broadcast unseen.
    return df.join(offsets, file).withColumn(name, F.col("_before") + F.col(row) + 1).drop("_before")


def number_rows(df: DataFrame, *order: Column | str, name: str = "id", kind: str = "bigint") -> DataFrame:
    return number(in_order(df, *order), name, kind)


def running_total(ordered: DataFrame, weight: str, name: str) -> DataFrame:
    """Inclusive running total of ``weight`` over the rows of :func:`kept_in_order`."""
    offsets = _offsets(ordered, F.col(weight))
    local = Window.partitionBy("_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ordered.withColumn("_part", F.shiftright("_seq", _ROW_BITS))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.sum(weight).over(local))
        .drop("_part", "_seq", "_before")
    )


def keyed_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], totals: dict[str, str]) -> DataFrame:
    """``df`` with inclusive running totals per ``keys`` in ``order``; ``totals`` maps new columns to numeric ones.

    Rows are sorted by ranges of (keys, order, scan position), so a key with half of all rows is dealt over many
    partitions. Each partition adds up its own rows of a key; what a key had in the partitions
    before is carried over. A partition shares keys with its neighbours only at its two ends, so there are at most twice as many
    carried rows as partitions, and those are broadcast. Equal places in ``order`` count in scan order.
    """
    keys = list(keys)
    # Written before the sort: finding the ranges reads the rows once more.
    ordered = in_order(keep(df, "to-order"), *keys, *order).withColumn("_part", F.shiftright("_seq", _ROW_BITS))
    sums = ordered.groupBy("_part", *keys).agg(*[F.sum(c).alias(f"_sum{i}") for i, c in enumerate(totals.values())])
    of_key = Window.partitionBy(*keys)
    earlier = of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("_parts", F.count(F.lit(1)).over(of_key)).select(
        "_part", "_parts", *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        *[F.coalesce(F.sum(f"_sum{i}").over(earlier), F.lit(0)).alias(f"_before{i}") for i in range(len(totals))]).filter("_parts > 1").drop("_parts")
    local = Window.partitionBy("_part", *keys).orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = ordered.select(*df.columns, "_part", *[F.sum(c).over(local).alias(f"_local{i}") for i, c in enumerate(totals.values())])
    same = rows["_part"] == carried["_part"]
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(carried[f"_key{i}"])
    return rows.join(F.broadcast(carried), same, "left").select(
        *[rows[c] for c in df.columns],
        *[(F.coalesce(F.col(f"_before{i}"), F.lit(0)) + F.col(f"_local{i}")).alias(name) for i, name in enumerate(totals)])
