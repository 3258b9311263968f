"""Quality rules and the verification report of a catalog."""

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numbers import assign_budget
from ..operators.numbering import in_order, running_total
from ..sources.catalog import catalog_path, read_catalog
from ..sources.schema import CATALOG_COLUMNS


_WHOLE = ("tinyint", "smallint", "int", "bigint")
#: Ids and bytes of one bitmap, and the bytes that an id costs in a shuffle.
BITMAP_IDS, BITMAP_BYTES, ID_BYTES = 32_768, 4_096, 8


class QualityError(ValueError):
    """An error rule failed."""


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole)


def _missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating-point column."""
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if dict(df.dtypes)[name] in ("double", "float") else c.isNull()


def missing_columns(df: DataFrame) -> list[str]:
    present = set(df.columns)
    return [c for c in CATALOG_COLUMNS if c not in present]


def quality_report(df: DataFrame, numbered: bool = False, corrupt: int | None = None) -> DataFrame:
    """One row per rule: ``rule, severity, value, threshold, failed``.

    Errors stop an ingest, warnings are reported, checks are the acceptance thresholds of
    a finished catalog. All counts come from one pass. How many ids stand more than once is an exact count of its own that
    reads the id column only (:func:`surplus_ids`); ids that the same job has just ``numbered`` 1..n are counted by bitmaps
    without a look at them first. ``corrupt`` adds a rule with the number of source rows that
    could not be read. Percentages are rounded to 6 places.
    """
    present = [c for c in CATALOG_COLUMNS if c in df.columns]
    n = F.col("n_rows")
    facts = df.agg(*fact_columns(df, present), *([F.min("id").alias("first_id"), F.max("id").alias("last_id")] if "id" in present and numbered else []))
    if "id" in present:
        facts = facts.withColumn("extra_ids", surplus_ids(df, dense=True if numbered else None).scalar())
        if numbered:  # a gap is an error as well
            whole = (n == 0) | ((F.col("first_id") == 1) & (F.col("last_id") == n))
            facts = facts.withColumn("extra_ids", F.when(F.coalesce(whole, F.lit(False)), F.col("extra_ids")).otherwise(n))
    else:
        facts = facts.withColumn("extra_ids", F.lit(0).cast("bigint"))
    return rules_of(facts, present, len(missing_columns(df)), corrupt)


def fact_columns(df: DataFrame, present: Sequence[str]) -> list[Column]:
    """Aggregates that the rules are judged by; all are counts, so those of parts of a table add up."""
    has, col = set(present).__contains__, F.col

    def count_if(name, condition, *needs):
        return F.count_if(condition if all(map(has, needs)) else F.lit(False)).alias(name)

    tier_differs = ~assign_budget(col("cost_for_two")).eqNullSafe(col("budget")) \
        if has("budget") and has("cost_for_two") else F.lit(False)
    return [
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(_missing(df, c)).alias(f"null_{c}") for c in present],
        count_if("bad_rating", ~F.isnan("rating") & ~col("rating").between(fixed.RATING_MIN, fixed.RATING_MAX), "rating"),
        count_if("no_cuisine", F.coalesce(F.size("cuisines"), F.lit(0)) <= 0, "cuisines"),
        count_if("bad_tier", col("budget").isNotNull() & ~col("budget").isin(fixed.TIERS), "budget"),
        count_if("tier_differs", col("budget").isNotNull() & col("cost_for_two").isNotNull() & tier_differs,
                 "budget", "cost_for_two"),
    ]


def rules_of(facts: DataFrame, present: Sequence[str], n_missing: int = 0, corrupt: int | None = None) -> DataFrame:
    """One row per rule from one row of :func:`fact_columns` and ``extra_ids``."""
    has, col, n = set(present).__contains__, F.col, F.col("n_rows")

    def rule(name, severity, value, threshold, failed):
        return F.struct(
            F.lit(name).alias("rule"),
            F.lit(severity).alias("severity"),
            F.round(value.cast("double"), 6).alias("value"),
            F.lit(float(threshold)).alias("threshold"),
            F.coalesce(failed, F.lit(False)).alias("failed"),
        )

    def above(name, severity, value, threshold):
        return rule(name, severity, value, threshold, value > threshold)

    rules = [
        rule("non_empty", "error", n, 0, n == 0),
        above("duplicate_ids", "error", col("extra_ids"), 0),
        above("missing_columns", "error", F.lit(n_missing), 0),
        *[above(f"null_pct_{c}", "warning", _pct(col(f"null_{c}"), n), fixed.NULL_WARN_PCT) for c in present],
        above("rating_out_of_range", "warning", col("bad_rating"), 0),
    ]
    if corrupt is not None:
        rules.append(above("corrupt_rows", "warning", F.lit(corrupt), 0))
    if has("budget"):
        rules.append(above("no_tier_pct", "warning", _pct(col("null_budget"), n), fixed.NO_TIER_WARN_PCT))
    if has("cuisines"):
        rules.append(above("no_cuisine_pct", "warning", _pct(col("no_cuisine"), n), fixed.NO_CUISINE_WARN_PCT))
    rules.append(rule("min_rows", "check", n, fixed.MIN_ROWS, n < fixed.MIN_ROWS))
    if has("name"):
        rules.append(above("null_names", "check", col("null_name"), 0))
    if has("location"):
        pct = _pct(col("null_location"), n)
        rules.append(rule("null_locations_pct", "check", pct, fixed.LOCATION_NULL_PCT, pct >= fixed.LOCATION_NULL_PCT))
    rules += [
        above("unknown_tiers", "check", col("bad_tier"), 0),
        above("tier_cost_mismatch", "check", col("tier_differs"), 0),
    ]
    return facts.select(F.inline(F.array(*rules)))


def surplus_ids(df: DataFrame, dense: bool | None = None) -> DataFrame:
    """One row, one column ``n``: rows beyond the first of each id; every null id is surplus.

    Exact in both ways. ``dense`` ids set bits: each task makes one bitmap of 4 KB per 32,768 neighbouring
    ids, bitmaps are merged per bucket, and rows without a bit of their own are surplus. Other ids are
    counted one by one. Unless told, :func:`bitmaps_pay` looks at the id ranges first.
    """
    whole = dict(df.dtypes)["id"] in _WHOLE
    if whole and (bitmaps_pay(df) if dense is None else dense):
        i = F.col("id").cast("bigint")
        per_bucket = df.groupBy(F.bitmap_bucket_number(i).alias("bucket")).agg(
            F.count(F.lit(1)).alias("n"), F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(i))).alias("bits"))
        surplus = F.when(F.col("bucket").isNull(), F.col("n")).otherwise(F.col("n") - F.col("bits"))
        return per_bucket.agg(F.coalesce(F.sum(surplus), F.lit(0)).alias("n"))
    per_id = df.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    # Null ids count as missing values, so each of them is surplus here.
    surplus = F.when(F.col("id").isNull(), F.col("n")).otherwise(F.col("n") - 1)
    return per_id.agg(F.coalesce(F.sum(surplus), F.lit(0)).alias("n"))


def bitmaps_pay(df: DataFrame) -> bool:
    """Whether bitmaps move fewer bytes than the ids: from the id range of each input partition, one row per partition.

    A task holds at most one bitmap per id, and one per bucket of its range.
    """
    parts = df.select("id", F.spark_partition_id().alias("part")).groupBy("part").agg(F.count("id").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    span = (F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)")) / BITMAP_IDS + 2
    sums = parts.agg(F.sum("n"), F.sum(F.least(F.col("n").cast("double"), span.cast("double")))).first()
    return bool(sums[0]) and sums[1] * BITMAP_BYTES <= sums[0] * ID_BYTES


def failed_errors(report: Iterable[Row]) -> list[str]:
    return [r["rule"] for r in report if r["severity"] == "error" and r["failed"]]


def check(report: Iterable[Row]) -> None:
    """Raise if an error rule failed."""
    failed = failed_errors(report)
    if failed:
        raise QualityError(f"catalog not published, failed rules: {', '.join(failed)}")


def null_rates(df: DataFrame) -> DataFrame:
    """Percentage of missing values (null or NaN) per column, all columns in one pass."""
    shares = df.agg(*[F.round(F.avg(_missing(df, c).cast("int")) * 100, 6).alias(c) for c in df.columns])
    return shares.unpivot([], df.columns, "column_name", "null_pct")


def budget_counts(catalog: DataFrame, with_null: bool = False) -> DataFrame:
    rows = catalog.select("budget") if with_null else catalog.select("budget").na.drop()
    return rows.groupBy("budget").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "budget")


def rating_summary(catalog: DataFrame) -> DataFrame:
    """Count, mean, sample deviation, min, exact interpolated quartiles, max: one row.

    Quartiles come from running counts over the distinct ratings, which stays
    distributed however many distinct values there are.
    """
    return summary_of(
        catalog.filter(F.col("rating").isNotNull() & ~F.isnan("rating"))
        .groupBy("rating").agg(F.count(F.lit(1)).alias("n"))
    )


def summary_of(values: DataFrame) -> DataFrame:
    """The summary from a table of distinct ratings with their counts (rating, n)."""
    counted = running_total(in_order(values, "rating"), "n", "upto")
    total = values.agg(F.sum("n")).scalar()

    def quartile(p):
        at = F.lit(p) * (F.col("total") - 1)
        value_at = lambda rank: F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("rating")))
        low, high = value_at(F.floor(at)), value_at(F.ceil(at))
        return low, high, at

    aggs, quarts = [], {}
    for name, p in [("q25", 0.25), ("q50", 0.5), ("q75", 0.75)]:
        low, high, _ = quartile(p)
        aggs += [low.alias(f"{name}_low"), high.alias(f"{name}_high")]
        at = F.lit(p) * (F.col("count") - 1)
        quarts[name] = F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (at - F.floor(at))
    n, r = F.col("n"), F.col("rating")
    moments = counted.withColumn("total", total).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("count"),
        (F.sum(r * n) / F.sum("n")).alias("mean"),
        F.sum(r * n).alias("s1"),
        F.sum(r * r * n).alias("s2"),
        F.min("rating").alias("min"),
        F.max("rating").alias("max"),
        *aggs,
    )
    variance = (F.col("s2") - F.col("s1") * F.col("s1") / F.col("count")) / (F.col("count") - 1)
    return moments.select(
        "count",
        F.round("mean", 6).alias("mean"),
        F.round(F.when(F.col("count") > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))), 6).alias("std"),
        "min",
        *[F.round(quarts[q], 6).alias(q) for q in ("q25", "q50", "q75")],
        "max",
    )


def top_locations(catalog: DataFrame, k: int = fixed.TOP_LOCATIONS) -> DataFrame:
    """The most frequent locations; the numbering window sees ``k`` rows only."""
    return top_of(catalog.select("location").na.drop().groupBy("location").agg(F.count(F.lit(1)).alias("n")), k)


def top_of(counts: DataFrame, k: int = fixed.TOP_LOCATIONS) -> DataFrame:
    top = counts.orderBy(F.desc("n"), "location").limit(k)
    return top.select(F.row_number().over(Window.orderBy(F.desc("n"), "location")).alias("pos"), "location", "n")


def catalog_preview(catalog: DataFrame, rows: int = fixed.PREVIEW_ROWS) -> DataFrame:
    return catalog.orderBy("id").limit(rows).select(
        "id",
        F.substring("name", 1, fixed.PREVIEW_NAME_CHARS).alias("name"),
        F.substring("location", 1, fixed.PREVIEW_LOCATION_CHARS).alias("location"),
        F.slice("cuisines", 1, fixed.PREVIEW_CUISINES).alias("cuisines"),
        "rating", "cost_for_two", "budget",
    )


def stored_size(spark: SparkSession, path: str) -> DataFrame:
    """Number and total size of the Parquet files of the newest version, from the file listing alone."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.parquet").load(catalog_path(spark, path))
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.round(F.sum("length") / 1024, 1).alias("size_kb"))


def verification(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The report over a stored catalog, one table per part."""
    catalog = read_catalog(spark, path)
    return {
        "columns": spark.createDataFrame(catalog.dtypes, "column_name string, type string"),
        "null_rates": null_rates(catalog),
        "budget_counts": budget_counts(catalog),
        "rating_summary": rating_summary(catalog),
        "top_locations": top_locations(catalog),
        "preview": catalog_preview(catalog),
        "size": stored_size(spark, path),
        "rules": quality_report(catalog),
    }
