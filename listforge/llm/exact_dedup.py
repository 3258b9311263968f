"""Exact duplicates by progressive refinement: length, then hash of a prefix, then hash of the whole text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, keep

PREFIX = 64
#: Bits that open heads are marked in where there are too many for a list; 64 MB whatever their number.
HEAD_BITS = 1 << 29


def _bit() -> Column:
    return F.pmod(F.xxhash64("_length", "_prefix"), F.lit(HEAD_BITS)).cast("bigint")


def exact_dedup(docs: DataFrame, carry: dict[str, Column] | None = None, prefix: int = PREFIX) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, and the expressions of ``carry``.

    Texts are equal when they are identical; null counts as empty. Of equal texts the row with the largest
    doc_id stays (null is smaller than any id; a group with no id at all keeps its rows' null).
    Rows that repeat an id and text are one document: each counts in group_size, all share
    ``kept``. An empty table gives an empty result; other columns are neither read nor changed.

    The first scan takes lengths and prefix hashes, two numbers a document. The lengths, then the
    (length, prefix) pairs that occur once are settled by these. Only the rest has its whole text
    hashed, in a second scan. No text is ever shuffled, and a group's size and winner come from
    partial aggregates, so a group may hold any share of the rows.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    sized = docs.select(docs["doc_id"], F.octet_length(text).alias("_length"), F.xxhash64(F.left(text, F.lit(prefix))).alias("_prefix"))
    heads = keep(sized.select("_length", "_prefix").groupBy("_length", "_prefix").agg(F.count(F.lit(1)).alias("_n")), "heads")
    lengths = heads.groupBy("_length").agg(F.sum("_n").alias("_all")).filter("_all > 1").drop("_all")
    open_heads = keep(heads.filter("_n > 1").join(lengths, "_length", "left_semi").select("_length", "_prefix", F.lit(True).alias("_open")), "open-heads")

    carry = carry or {}
    wide = docs.select(docs["doc_id"], text.alias("_text"), F.octet_length(text).alias("_length"),
                       F.xxhash64(F.left(text, F.lit(prefix))).alias("_prefix"), *[c.alias(k) for k, c in carry.items()])
    full = F.unhex(F.sha2("_text", 256))
    if open_heads.count() <= BROADCAST_ROWS:
        marked = wide.join(F.broadcast(open_heads), ["_length", "_prefix"], "left").withColumn("_full", F.when(F.col("_open"), full))
    else:
        # Too many for a broadcast as they are, so as bits: a text is hashed if the bit of its head is set. A bit that
        # another head has set costs one hash more; such a text is then alone in its group.
        bits = open_heads.select(_bit().alias("bit")).groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("_bits"))
        bits = keep(bits, "open-bits")  # at most HEAD_BITS / 8 bytes
        bucket = F.bitmap_bucket_number(_bit() + 1).alias("_bucket")
        marked = wide.withColumn("_bucket", bucket).join(F.broadcast(bits), "_bucket", "left")
        at = F.bitmap_bit_position(_bit() + 1)
        byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        mask = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (at % 8 + 1).cast("int"))
        marked = marked.withColumn("_full", F.when(F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False)), full))
    rows = keep(marked.select("doc_id", "_length", "_prefix", "_full", *carry), "hashed")
    groups = (rows.filter("_full is not null").groupBy("_length", "_full")
              .agg(F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_size")).filter("_size > 1"))
    groups = keep(groups, "groups")  # a join of two scans splits a group with very many rows
    # Settled rows differ in _prefix, so that their null hash does not bring them together.
    joined = (rows.withColumn("_key", F.coalesce("_full", F.unhex(F.hex("_prefix"))))
              .join(groups.withColumnRenamed("_full", "_key"), ["_length", "_key"], "left"))
    keep_id = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return joined.select("doc_id", keep_id.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep_id).alias("kept"), *carry)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each text, that of the largest doc_id; columns unchanged.

    Rows that repeat an id and text, and copies that have no id at all, are copies as well: the first in storage order stays, if ``docs``
    is a stored table, else any one.
    """
    mark = F.xxhash64(F.coalesce(docs["text"], F.lit("")))  # an id may stand at several texts
    flags = keep(exact_dedup(docs, {"_mark": mark}).select("doc_id", "kept", "_mark"), "flags")
    gone = flags.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"), "_mark").distinct()
    left = flags.filter("kept").groupBy("doc_id", "_mark").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return one_row_each(docs, mark, keep(gone, "copies"), keep(left.select(F.col("doc_id").alias("_id"), "_mark"), "repeated"))


def one_row_each(docs: DataFrame, mark: Column, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without the (id, mark) pairs ``gone``, and with one row of each pair ``repeated``; both are kept tables.

    Repeated rows alone are shuffled, by pair and first by input partition, so a row repeated any number of times is no hot spot.
    """
    def side(df):
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    columns = docs.columns
    marked = docs.withColumn("_listforge_mark", mark)
    id_ = F.col("doc_id")
    left = marked.join(side(gone), id_.eqNullSafe(gone["_gone"]) & (F.col("_listforge_mark") == gone["_mark"]), "left_anti")
    if repeated.isEmpty():
        return left.select(*columns)
    more = side(repeated)
    same = id_.eqNullSafe(repeated["_id"]) & (F.col("_listforge_mark") == repeated["_mark"])
    rows = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    firsts = (left.join(more, same, "left_semi").select("doc_id", "_listforge_mark", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"), rows)
              .groupBy("doc_id", "_listforge_mark", "_part").agg(F.min_by("_row", "_at").alias("_row"), F.min("_at").alias("_at"))
              .groupBy("doc_id", "_listforge_mark").agg(F.min_by("_row", "_at").alias("_row")).select("_row.*"))
    return left.join(more, same, "left_anti").select(*columns).union(firsts)
