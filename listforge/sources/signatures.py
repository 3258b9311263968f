"""Which files of a catalog can hold a substring: one bitmap of hashed grams per file and column.

A text that holds a query holds every piece of up to three characters of it. So a file whose bitmap lacks one of the query's
pieces has no such text and is not opened. A bit may be set by another piece: files are left out, rows never.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import exists

GRAM = 3
#: Bits of one bitmap, as many as Spark's bitmap functions hold in one bucket.
BITS = 32_768
#: More files than this are read by their folder, without a list of names.
MOST_FILES = 10_000

_FOLDER = "_signatures"
_SHAPE = "file string, column string, bits binary"


def _bit(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BITS)).cast("bigint")


def _grams(text: Column) -> Column:
    """Every piece of one to three characters."""
    at = lambda i: F.array(*[text.substr(i, F.lit(n)) for n in range(1, GRAM + 1)])
    return F.when(text != "", F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(text)), at))))


def _needed(query: str) -> list[str]:
    query = query.lower()
    return sorted({query[i : i + GRAM] for i in range(max(1, len(query) - GRAM + 1))})


def write_signatures(spark: SparkSession, folder: str) -> None:
    """Bitmaps of the lower-case places and dishes of each file in ``folder``, stored beside them.

    Each distinct text of a file is cut once; a file's grams meet as bits of partial bitmaps.
    """
    rows = spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("file"), F.lower("location").alias("location"), F.transform("cuisines", F.lower).alias("cuisines"))
    texts = rows.select("file", F.lit("location").alias("column"), F.col("location").alias("text")).distinct().union(
        rows.select("file", F.lit("cuisines").alias("column"), F.explode("cuisines").alias("text")).distinct())
    bits = texts.select("file", "column", F.explode(_grams(F.col("text"))).alias("gram")).select("file", "column", _bit(F.col("gram")).alias("bit"))
    every = rows.select("file").distinct().withColumn("column", F.explode(F.array(F.lit("location"), F.lit("cuisines")))).withColumn("bit", F.lit(None).cast("bigint"))
    bits.union(every).groupBy("file", "column").agg(F.bitmap_construct_agg("bit").alias("bits")).write.parquet(f"{folder}/{_FOLDER}")


def _has(bits: Column, gram: str) -> Column:
    bit = _bit(F.lit(gram))
    byte = F.conv(F.hex(F.substring(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (bit % 8 + 1).cast("int"))) != 0


def files_holding(spark: SparkSession, folder: str, location: str | None = None, cuisine: str | None = None) -> list[str] | None:
    """Files of ``folder`` that can hold both substrings; None if the folder has no signatures or too many files fit."""
    if not exists(spark, f"{folder}/{_FOLDER}"):
        return None
    known = spark.read.schema(_SHAPE).parquet(f"{folder}/{_FOLDER}")
    fits = F.lit(True)
    for column, query in (("location", location), ("cuisines", cuisine)):
        for gram in _needed(query) if query else []:
            fits = fits & ((F.col("column") != column) | _has(F.col("bits"), gram))
    found = known.groupBy("file").agg(F.bool_and(fits).alias("fits")).filter("fits").select("file").limit(MOST_FILES + 1).collect()
    return None if len(found) > MOST_FILES else sorted(r["file"] for r in found)


def read_holding(spark: SparkSession, folder: str, location: str | None = None, cuisine: str | None = None) -> DataFrame:
    """The stored rows of the files that can hold the substrings; the caller's filter still decides."""
    whole = spark.read.parquet(folder)
    files = files_holding(spark, folder, location, cuisine) if location or cuisine else None
    if files is None:
        return whole
    if not files:
        return whole.limit(0)
    return spark.read.schema(whole.schema).option("basePath", folder).parquet(*files)
