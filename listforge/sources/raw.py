"""Raw listing tables and the mapping of their columns."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lines import records

# File and row number of a raw row; together they give the input order.
POSITION = ["_file", "_row"]
# Holds the text of a record that does not fit the columns.
CORRUPT = "_corrupt_record"


def read_raw(spark: SparkSession, path: str, fmt: str = "parquet", splits: Sequence[str] | None = None, positions: bool = False,
             schema: str | T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """Read an exported table; of several splits (sub-folders) the first named one is used.

    CSV columns are read as text, JSON scalars too (``primitivesAsString``): the
    cleaners decide what a value means. A ``schema`` spares the pass that finds the columns; with it CSV and JSON
    records that do not fit are marked in the column CORRUPT. CSV records may hold quoted line breaks; a
    file is then one task, and ``multi_line=False`` splits large files that have none. ``positions`` adds the
    :data:`POSITION` columns, from which an ingest numbers the rows in input order without sorting. With it CSV (header in
    each file, quoted line breaks or not) and JSON lines are split by byte ranges as well, however large a file is.
    """
    if positions and fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"{fmt} rows have no positions: number them by an order column")
    source = f"{path.rstrip('/')}/{splits[0]}" if splits else path
    reader = spark.read.format(fmt)
    if schema is not None:
        shape = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if fmt != "parquet" and CORRUPT not in shape.fieldNames():
            shape = T.StructType([*shape.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.schema(shape).option("columnNameOfCorruptRecord", CORRUPT)
    if fmt == "csv":
        reader = reader.options(header=True, inferSchema=False, multiLine=multi_line, escape='"')
    elif fmt == "json":
        reader = reader.options(primitivesAsString=True)
    table = reader.load(source)
    if not positions:
        return table
    if fmt == "csv":
        rows = records(spark, source).filter(F.col("_row") > 0).withColumn("_row", F.col("_row") - 1)
        read = F.from_csv("record", _ddl(table.schema), {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
        return rows.select(read.alias("_read"), *POSITION).select("_read.*", *POSITION)
    if fmt == "json":
        read = F.from_json("record", table.schema, {"primitivesAsString": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
        return records(spark, source, quotes=False).select(read.alias("_read"), *POSITION).select("_read.*", *POSITION)
    return table.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def _ddl(shape: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in shape.fields)


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate present, in exact case; names may hold blanks and brackets.

    Columns that differ in case only need ``spark.sql.caseSensitive=true``.
    """
    present = set(df.columns)
    return next((c for c in candidates if c in present), None)
