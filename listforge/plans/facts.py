"""Quality facts of a stored catalog kept per file: reports merge them and read only files that are new.

Every fact is a sum, an extreme or a bitmap, so the facts of two files are merged without their rows. They are stored
beside the files and grow with the number of files and of distinct ratings, tiers and places in each.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import canonical, catalog_path
from ..sources.schema import CATALOG_COLUMNS
from ..sources.shared import exists
from .quality import fact_columns, rules_of, summary_of, top_of

_COUNTS = ("rating", "budget", "location")
_FILES, _VALUES, _IDS = "files", "values", "ids"


@dataclass(frozen=True)
class Facts:
    """``files``: a row of counts per file; ``values``: file, column, value, n; ``ids``: file, bucket, n, bits."""

    files: DataFrame
    values: DataFrame
    ids: DataFrame


def _write(rows: DataFrame, folder: str) -> None:
    """Facts of the files of canonical ``rows`` (with a column file); the row of counts comes last and makes them valid."""
    i = F.col("id")
    rows.groupBy("file", F.bitmap_bucket_number(i).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.bitmap_construct_agg(F.bitmap_bit_position(i)).alias("bits")).write.mode("append").parquet(f"{folder}/{_IDS}")
    parts = [rows.groupBy("file", F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")) for c in _COUNTS]
    parts[0].union(parts[1]).union(parts[2]).write.mode("append").parquet(f"{folder}/{_VALUES}")
    rows.groupBy("file").agg(*fact_columns(rows, CATALOG_COLUMNS)).write.mode("append").parquet(f"{folder}/{_FILES}")


def facts(spark: SparkSession, path: str) -> Facts:
    """Facts of the newest version at ``path``; files without any are read now and theirs are stored, all others are left alone.

    A file counts once its row of counts is there, so what a broken run has left is read past: facts of a file that come twice
    are the same and count once.
    """
    folder = catalog_path(spark, path)
    stored = f"{folder}/_facts"
    present = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.parquet").load(folder).select(F.col("path").alias("file"))
    if exists(spark, f"{stored}/{_FILES}"):
        present = present.join(spark.read.parquet(f"{stored}/{_FILES}").select("file"), "file", "left_anti")
    new = [r["file"] for r in present.collect()]  # names of files, as many as one append brought
    if new:
        rows = spark.read.option("basePath", folder).schema(spark.read.parquet(folder).schema).parquet(*new)
        _write(canonical(rows, True, keep_file=True), stored)
    return Facts(*(spark.read.parquet(f"{stored}/{part}").dropDuplicates(key) for part, key in (
        (_FILES, ["file"]), (_VALUES, ["file", "column", "value"]), (_IDS, ["file", "bucket"]))))


def _merged(found: Facts) -> DataFrame:
    sums = found.files.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in found.files.columns if c != "file"])
    buckets = found.ids.groupBy("bucket").agg(F.sum("n").alias("n"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("bits"))
    surplus = buckets.agg(F.coalesce(F.sum(F.when(F.col("bucket").isNull(), F.col("n")).otherwise(F.col("n") - F.col("bits"))), F.lit(0)))
    return sums.withColumn("extra_ids", surplus.scalar())


def _counts(found: Facts, column: str) -> DataFrame:
    return found.values.filter(F.col("column") == column).groupBy("value").agg(F.sum("n").alias("n"))


def report_from_facts(found: Facts) -> DataFrame:
    """:func:`quality.quality_report` of all rows."""
    return rules_of(_merged(found), CATALOG_COLUMNS)


def null_rates_from_facts(found: Facts) -> DataFrame:
    rates = _merged(found).select(*[F.round(F.col(f"null_{c}") * 100 / F.col("n_rows"), 6).alias(c) for c in CATALOG_COLUMNS])
    return rates.unpivot([], CATALOG_COLUMNS, "column_name", "null_pct")


def budget_counts_from_facts(found: Facts) -> DataFrame:
    return _counts(found, "budget").filter("value is not null").select(F.col("value").alias("budget"), "n")


def rating_summary_from_facts(found: Facts) -> DataFrame:
    return summary_of(_counts(found, "rating").select(F.col("value").cast("double").alias("rating"), "n").filter("rating is not null"))


def top_locations_from_facts(found: Facts) -> DataFrame:
    return top_of(_counts(found, "location").filter("value is not null").withColumnRenamed("value", "location"))
