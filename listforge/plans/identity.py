"""Ids that stay with their rows from one ingest to the next.

An id map names every row ever published by the hash of its cleaned values and its number among equal rows. Rows that come again get the
id they had, new rows continue after the largest id ever given, and rows that are gone keep a tombstone, so
no id is given twice and a stored response never points at another listing.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import keyed_totals, number_rows
from ..sources.schema import CATALOG_COLUMNS
from ..sources.shared import keep
from .ingest import clean

VALUES = [c for c in CATALOG_COLUMNS if c != "id"]
#: ``seen``: the last ingest that held the row.
ID_MAP = "print binary, nth bigint, id bigint, seen bigint"


def fingerprint() -> Column:
    """SHA-256 of a cleaned row; every value has its length in front, a missing one has none."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    def parts_of(c: Column) -> Column:
        return F.concat(F.size(c).cast("string"), F.lit("["), F.array_join(F.transform(c, part), ""), F.lit("]"))

    parts = [parts_of(F.col(c)) if c == "cuisines" else part(F.col(c)) for c in VALUES]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def stable_ids(raw: DataFrame, id_map: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Catalog and next id map of a raw table; an empty map gives the ids 1..n in ``order``.

    Of equal rows the first in ``order`` gets the smallest of their ids. Equal rows are numbered by ranges
    over many tasks, so a row that makes a third of the table is no hot spot. Both results are kept tables.
    """
    order = list(order)
    rows = clean(raw, order).withColumn("print", fingerprint()).withColumn("_one", F.lit(1).cast("bigint"))
    numbered = keep(keyed_totals(rows, ["print"], order, {"nth": "_one"}).drop("_one"), "numbered")
    last = id_map.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id"), F.coalesce(F.max("seen"), F.lit(0)).alias("seen")).first()
    matched = keep(numbered.join(id_map.select("print", "nth", "id"), ["print", "nth"], "left"), "matched")
    old = matched.filter(F.col("id").isNotNull())
    new = number_rows(matched.filter(F.col("id").isNull()).drop("id"), *order, "print", "nth").withColumn("id", F.col("id") + last["id"])
    catalog = keep(old.unionByName(new), "with-ids")
    now = F.lit(last["seen"] + 1).cast("bigint").alias("seen")
    gone = id_map.join(old.select("id"), "id", "left_anti").select("print", "nth", "id", "seen")
    following = keep(catalog.select("print", "nth", "id", now).union(gone), "id-map")
    return catalog.select(*CATALOG_COLUMNS), following


def tombstones(id_map: DataFrame) -> DataFrame:
    """Ids of rows that the last ingest no longer held."""
    return id_map.filter(F.col("seen") < id_map.agg(F.max("seen")).scalar()).select("id")
