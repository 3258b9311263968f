"""Records of text files with their positions, whatever byte ranges the scan splits the files into.

A line starts a CSV record exactly if an even number of quotes comes before it in its file (an escaped quote is two). Each range finds
the parity of its lines from its own start; the parities and record counts of the ranges before, one row per range,
settle the rest. So a file with quoted line breaks is read by many tasks, and every record knows its number.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import keep

_LINE = "file string, block bigint, seq bigint, line string, odd boolean, before int, even_rows bigint, odd_rows bigint"


def _marked(quotes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines with the parity of quotes before them and the running counts of record starts for either parity, within their range."""
        at, parity, counts = None, 0, np.zeros(2, np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            line = batch.column("line")
            odd = (pc.count_substring(line, '"').to_numpy(zero_copy_only=False).astype(np.int64) & 1) if quotes else np.zeros(n, np.int64)
            filled = pc.not_equal(pc.utf8_trim_whitespace(line), "").to_numpy(zero_copy_only=False)
            before, rows = np.zeros(n, np.int64), np.zeros((2, n), np.int64)
            files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
            cuts = [0, *(i for i in range(1, n) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]), n]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if at != (files[low], blocks[low]):
                    at, parity, counts = (files[low], blocks[low]), 0, np.zeros(2, np.int64)
                after = (parity + np.cumsum(odd[low:high])) & 1
                before[low:high] = np.r_[parity, after[:-1]]
                for p in (0, 1):
                    rows[p, low:high] = counts[p] + np.cumsum(filled[low:high] & (before[low:high] == p))
                parity, counts = int(after[-1]), rows[:, high - 1].copy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), batch.column("seq"), line, pa.array(odd == 1), pa.array(before, pa.int32()), pa.array(rows[0]), pa.array(rows[1])],
                names=[c.split()[0] for c in _LINE.split(", ")])
    return run


def records(spark: SparkSession, path: str, quotes: bool = True) -> DataFrame:
    """Columns _file, _row (from 0), record for every record of the text files at ``path``; blank lines between records do not count.

    With ``quotes`` a record goes on over line breaks inside double quotes, else each line is one. Records of one line, nearly
    all, stay in the task that reads them; only the lines of longer ones are brought together. A quote that is never
    closed makes one record of the rest of its file, as in any reader.
    """
    text = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))
    # Written once: the ranges could be cut elsewhere if the files were scanned again.
    lines = keep(text.mapInArrow(_marked(quotes), _LINE), "lines")
    ranges = lines.groupBy("file", "block").agg(F.sum(F.col("odd").cast("int")).alias("quotes"), F.max("even_rows").alias("even"), F.max("odd_rows").alias("odd"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranges.select("file", "block", "even", "odd", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2).cast("int").alias("inside"))
    found = F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("odd"))
    starts = keep(inside.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "inside", F.coalesce(F.sum(found).over(earlier), F.lit(0)).alias("rows_before")), "ranges")
    placed = lines.join(starts, (lines["file"] == starts["_file"]) & (lines["block"] == starts["_block"]))
    is_start = F.col("before") == F.col("inside")
    here = F.when(F.col("inside") == 0, F.col("even_rows")).otherwise(F.col("odd_rows"))
    placed = placed.select("_file", (F.col("rows_before") + here - 1).alias("_row"), "seq", "line", "odd", is_start.alias("starts"))
    blank = F.col("starts") & ~F.col("odd") & (F.trim(F.regexp_replace("line", r"[\s]+", "")) == "")
    whole = placed.filter(F.col("starts") & ~F.col("odd") & ~blank).select("_file", "_row", F.col("line").alias("record"))
    if quotes:
        long = placed.filter(~F.col("starts") | F.col("odd")).groupBy("_file", "_row").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("parts"))
        whole = whole.union(long.select("_file", "_row", F.array_join(F.transform("parts", lambda p: p["line"]), "\n")))
    return whole.withColumn("record", F.regexp_replace("record", r"\r\z", ""))
