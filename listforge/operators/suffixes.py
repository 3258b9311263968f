"""Substring search in a dictionary of distinct texts by a sorted table of their suffixes.

A text holds a query exactly if one of its suffixes begins with it, and those suffixes stand side by side in sorted order. So a
query of any length is one range of the table: no candidates are checked, and no gram that many texts share
is joined.
"""

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import keep

#: Characters of a suffix that are stored; longer queries are looked up by so many and then compared whole.
HEAD = 64
#: Suffixes of one part, about; one task holds one part, the driver one suffix of each part.
PART_ROWS = 100_000


@dataclass(frozen=True)
class SuffixTable:
    """``rows``: part, kind, head, text, sorted by (kind, head, text) over parts 0, 1, ...; ``bounds``: part, kind, head of each part's first row."""

    rows: DataFrame
    bounds: DataFrame


def suffix_rows(texts: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The sorted table over texts (kind, text); parts are ranges of (kind, head, text), so a common suffix may cover several."""
    known = texts.filter(F.col("text").isNotNull() & (F.col("text") != "")).select("kind", "text").distinct()
    rows = keep(known.select("kind", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at"), "text")
                .select("kind", F.col("text").substr(F.col("at"), F.lit(HEAD)).alias("head"), "text").distinct(), "suffixes")
    parts = max(1, -(-rows.count() // part_rows))
    return rows.repartitionByRange(parts, "kind", "head", "text").sortWithinPartitions("kind", "head", "text").select(F.spark_partition_id().alias("part"), "kind", "head", "text")


def bounds_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part").agg(F.min(F.struct("kind", "head")).alias("first")).select("part", "first.kind", "first.head")


def suffix_table(texts: DataFrame, part_rows: int = PART_ROWS) -> SuffixTable:
    """A kept table over texts (kind, text); kinds are separate dictionaries in one table."""
    rows = keep(suffix_rows(texts, part_rows), "suffix-table")
    return SuffixTable(rows, keep(bounds_of(rows), "suffix-bounds"))


def _to_parts(bounds: list[tuple[str, str]], numbers: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, kinds, queries = [], [], []
            for kind, query in zip(batch.column("kind").to_pylist(), batch.column("query").to_pylist(), strict=True):
                probe = query[:HEAD]
                # The part before the first bound not below the probe may end with its first suffixes.
                first = max(0, bisect_left(bounds, (kind, probe)) - 1)
                after = bisect_right(bounds, (kind, probe), key=lambda b, n=len(probe): (b[0], b[1][:n]))
                for i in range(first, max(after, first + 1)):
                    part.append(numbers[i])
                    kinds.append(kind)
                    queries.append(query)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kinds, pa.string()), pa.array(queries, pa.string())], names=["part", "kind", "query"])
    return run


def _matching():
    # A function of its own, so that it travels with its code.
    def matches(suffixes: pa.Table, queries: pa.Table) -> pa.Table:
        """Queries of a part with the texts that hold them, each pair once."""
        out: dict[str, list[str]] = {"kind": [], "query": [], "text": []}
        if suffixes.num_rows and queries.num_rows:
            table = sorted(zip(*[suffixes.column(c).to_pylist() for c in ("kind", "head", "text")], strict=True))
            heads, texts = [(kind, head) for kind, head, _ in table], [text for *_, text in table]
            for kind, query in zip(queries.column("kind").to_pylist(), queries.column("query").to_pylist(), strict=True):
                probe = query[:HEAD]
                low = bisect_left(heads, (kind, probe))
                high = bisect_right(heads, (kind, probe), low, key=lambda h, n=len(probe): (h[0], h[1][:n]))
                found = {t for t in texts[low:high] if len(query) <= HEAD or query in t}
                out["kind"] += [kind] * len(found)
                out["query"] += [query] * len(found)
                out["text"] += sorted(found)
        return pa.table({c: pa.array(v, pa.string()) for c, v in out.items()})
    return matches


def texts_holding(queries: DataFrame, table: SuffixTable) -> DataFrame:
    """Kept pairs kind, query, text with ``query`` inside ``text``, for queries (kind, query); blank queries match nothing."""
    first = table.bounds.orderBy("part").collect()
    asked = queries.filter(F.col("query").isNotNull() & (F.col("query") != "")).select("kind", "query").distinct()
    if not first:
        return asked.limit(0).withColumn("text", F.lit(None).cast("string"))
    places = asked.mapInArrow(_to_parts([(r["kind"], r["head"]) for r in first], [r["part"] for r in first]), "part int, kind string, query string")
    found = table.rows.groupBy("part").cogroup(places.groupBy("part")).applyInArrow(_matching(), "kind string, query string, text string")
    # A text may hold the query several times, in suffixes of several parts.
    return keep(found.distinct(), "held-texts")
