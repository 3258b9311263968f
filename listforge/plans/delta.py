"""Best listings per cell kept up under catalog changes, without ranking the catalog again.

A cell's state holds its ``k + slack`` best listings. Removed listings leave it; added ones enter as far as they rank above the
worst old listing still held, since below that the catalog may hold listings the state never saw. Only a
cell that falls below ``k`` this way is filled again from the catalog.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.topk import best_per_hot_key, best_per_key
from ..sources.shared import keep
from .shortlist import CELL, cell_rows, sized

#: Listings held beyond the ``k`` that shortlists need.
SLACK = 40


def cell_state(catalog: DataFrame, k: int = fixed.SHORTLIST_SIZE, slack: int = SLACK) -> DataFrame:
    """The ``k + slack`` best listings of every cell with ``whole``: whether the cell has no others."""
    best = best_per_hot_key(cell_rows(catalog), CELL, k + slack, "cell_pos")
    return _with_whole(best, k + slack)


def _with_whole(best: DataFrame, most: int) -> DataFrame:
    full = best.filter(F.col("cell_pos") == most).select(*CELL, F.lit(False).alias("whole"))
    return best.join(full, CELL, "left").withColumn("whole", F.coalesce("whole", F.lit(True)))


def cells_of(state: DataFrame, k: int = fixed.SHORTLIST_SIZE) -> DataFrame:
    """The cells that shortlists are answered from; the state should be a kept table."""
    rows = state.filter(F.col("cell_pos") <= k).drop("whole")
    return rows.withColumn("id", sized(F.col("id"), "id", k))


def changes(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of listings that went or changed, and listings that came or changed, between two versions with stable ids."""
    mark = F.xxhash64(*[F.col(c) for c in old.columns if c != "id"])
    before, after = old.select("id", mark.alias("_old")), new.select("id", mark.alias("_new"))
    differs = keep(before.join(after, "id", "full").filter(~F.col("_old").eqNullSafe(F.col("_new"))), "changed-ids")
    removed = differs.filter(F.col("_old").isNotNull()).select("id")
    return removed, new.join(differs.filter(F.col("_new").isNotNull()).select("id"), "id", "left_semi").select(*new.columns)


def update_cells(state: DataFrame, removed: DataFrame, added: DataFrame, catalog: DataFrame,
                 k: int = fixed.SHORTLIST_SIZE, slack: int = SLACK) -> DataFrame:
    """The kept :func:`cell_state` of the new ``catalog``, from the old state, removed ids and added listings.

    A changed listing is removed and added. Cells that no change touches are passed on as they stand; the
    catalog is read only for cells that lost more than their slack.
    """
    most = k + slack
    gone = removed.select("id").distinct()
    fresh = keep(best_per_hot_key(cell_rows(added), CELL, most, "_pos").drop("_pos"), "fresh")
    touched = keep(state.join(gone, "id", "left_semi").select(*CELL).union(fresh.select(*CELL)).distinct(), "touched")
    hit = keep(state.join(touched, CELL, "left_semi"), "hit")
    old = keep(hit.join(gone, "id", "left_anti").drop("cell_pos", "whole"), "left-over")
    # Ordered like the ranking: the least rating, of equals the largest id, is the worst.
    floors = old.groupBy(*CELL).agg(F.min(F.struct("rating", (-F.col("id")).alias("back"))).alias("floor"))
    known = keep(hit.groupBy(*CELL).agg(F.bool_and("whole").alias("whole")).join(floors, CELL, "left"), "floors")
    placed = fresh.join(known, CELL, "left").filter(
        F.coalesce("whole", F.lit(True)) | (F.struct("rating", (-F.col("id")).alias("back")) > F.col("floor"))).select(*old.columns)
    ranked = keep(best_per_key(old.unionByName(placed), CELL, most, "cell_pos"), "ranked")
    sizes = ranked.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    short = keep(known.filter(~F.col("whole")).join(sizes, CELL, "left").filter(F.coalesce("n", F.lit(0)) < k).select(*CELL), "short-cells")
    calm = state.join(touched, CELL, "left_anti")
    was_whole = ranked.join(known.select(*CELL, F.col("whole").alias("_was")), CELL, "left").join(sizes, CELL)
    steady = was_whole.join(short, CELL, "left_anti").withColumn("whole", F.coalesce("_was", F.lit(True)) & (F.col("n") < most))
    out = calm.unionByName(steady.select(*state.columns))
    if not short.isEmpty():
        refilled = best_per_hot_key(cell_rows(catalog).join(short, CELL, "left_semi"), CELL, most, "cell_pos")
        out = out.unionByName(_with_whole(refilled, most).select(*state.columns))
    return keep(out, "cell-state")
