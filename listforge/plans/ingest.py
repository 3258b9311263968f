"""Raw listings to a checked catalog."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import fixed, numbers, text
from ..operators.numbering import kept_in_order, number, number_in_files, range_sorted
from ..sources.catalog import write_catalog
from ..sources.raw import CORRUPT, POSITION, resolve_column
from ..sources.schema import CATALOG_COLUMNS
from ..sources.shared import keep, kept_tables
from .quality import check, quality_report

_NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def clean(raw: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Canonical columns without ``id``, after the columns to ``carry`` along.

    Projections: cut texts, parse, split and derive. Catalyst keeps them apart because each uses results of
    the one before more than once, so no cleaning step runs twice for a row.
    """
    types = {name: kind for name, kind in raw.dtypes}
    resolved = {name: resolve_column(raw, aliases) for name, aliases in fixed.COLUMN_ALIASES.items()}

    def source(name, textual, numeric=None):
        found = resolved[name]
        if found is None:
            return F.lit(None).cast("string").alias(name)
        kind = types[found]
        c = F.col(f"`{found}`")
        if numeric is not None and (kind in _NUMERIC or kind.startswith("decimal")):
            return numeric(c.cast("double")).alias(name)
        return textual(c.cast("string")).alias(name)

    cut = raw.select(
        *carry,
        source("name", text.strip),
        source("location", lambda c: F.nullif(text.collapse(text.strip(c)), F.lit(""))),
        source("cuisines", text.strip),
        source("rating", numbers.rating_text, lambda c: c),
        source("cost_for_two", numbers.cost_text, numbers.numeric_cost),
    )
    kinds = dict(cut.dtypes)
    number = lambda c: F.col(c) if kinds[c] == "double" else numbers.parse_number(F.col(c)).alias(c)
    parsed = cut.select(
        *carry,
        F.coalesce("name", F.lit(fixed.UNKNOWN_NAME)).alias("name"),
        text.title(F.col("location")).alias("location"),
        text.title(F.col("cuisines")).alias("cuisines"),
        number("rating"),
        number("cost_for_two"),
    )
    return parsed.select(
        *carry, "name", "location",
        text.comma_parts(F.col("cuisines")).alias("cuisines"),
        numbers.in_rating_range(F.col("rating")).alias("rating"),
        "cost_for_two",
        numbers.assign_budget(F.col("cost_for_two")).alias("budget"),
    )


def clean_catalog(raw: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """The catalog with ids 1..n in the order of the given source columns.

    Raw rows are sorted before they are cleaned: the sampling pass of the sort then reads raw
    columns only and every row is cleaned once. Without ``order`` nothing is shuffled: ids follow
    the input order if ``raw`` was read with positions, else the order in which Spark scans it.
    """
    if not order and set(POSITION) <= set(raw.columns):
        return number_in_files(keep(clean(raw, POSITION), "ordered"), *POSITION, "id").select(*CATALOG_COLUMNS)
    used = [c for c in (resolve_column(raw, a) for a in fixed.COLUMN_ALIASES.values()) if c]
    rows = raw
    if order:
        needed = list(dict.fromkeys([*order, *used]))
        rows = range_sorted(raw.select(*[F.col(f"`{c}`") for c in needed]), *[F.col(f"`{c}`") for c in order])
    return number(kept_in_order(clean(rows)), "id").select(*CATALOG_COLUMNS)


@dataclass(frozen=True)
class Ingested:
    rows: int
    report: list[Row]


def _corrupt_rows(raw: DataFrame) -> int:
    # Spark reads no such mark alone, without the columns that the record should fill.
    others = [F.count(F.col(f"`{c}`")) for c in raw.columns if c != CORRUPT]
    return raw.agg(F.count_if(F.col(CORRUPT).isNotNull()), *others).first()[0]


def ingest(raw: DataFrame, path: str, order: Sequence[str] = (), partition_by_budget: bool = False) -> Ingested:
    """Clean, check, publish. The checks run on the kept stage, so nothing is published on failure."""
    with kept_tables(raw.sparkSession):
        corrupt = _corrupt_rows(raw) if CORRUPT in raw.columns else None
        catalog = clean_catalog(raw, order)
        report = quality_report(catalog, numbered=True, corrupt=corrupt).collect()  # one row per rule
        check(report)
        return Ingested(write_catalog(catalog, path, partition_by_budget), report)
