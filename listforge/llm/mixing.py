"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from math import gcd

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import keyed_totals
from ..sources.shared import keep
from .common import BROADCAST_ROWS, WORD, ordered_totals

SHARDS = 8
#: Blocks of a shard: at least, at most, and the words of a block in between.
BLOCKS, MOST_BLOCKS, BLOCK_WORDS = 64, 4096, 16_000_000
SEED = 5


def _goals(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Columns source, source_size, target, _number (from 0 in code point order, null last), kept."""
    listed = sizes.select("source", F.col("source_size").cast("long").alias("source_size"), F.lit(1).alias("_one"))
    numbered = ordered_totals(listed, [], [F.asc_nulls_last("source")], {"_number": "_one"})
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("_number") % len(weights) + 1).cast("int"))
    # int / int: the ratio's order decides, equal ratios stop together.
    rows = keep(numbered.withColumn("_w", w).withColumn("_ratio", F.col("source_size") * F.lit(most) / F.col("_w")), "sources")
    whole, weight = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    run = ordered_totals(rows, [], ["_ratio", "_number"], {"_stopped": "source_size", "_gone": "_w", "_at": "_one"})
    level = (F.lit(float(whole) * share) - F.col("_stopped") * F.lit(most)) / (F.lit(weight) - F.col("_gone"))
    ends = run.withColumn("_level", level).filter(F.col("_level") <= F.col("_ratio")).agg(F.min_by("_level", "_at")).first()[0]
    target = F.col("source_size") * F.lit(most)
    if ends is not None:
        target = F.least(target, F.lit(ends) * F.col("_w"))
    return keep(rows.select("source", "source_size", target.cast("double").alias("target"), "_number"), "targets")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Columns source, source_size, target for a table (source, source_size) with one row per source, of which there may be any number.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` times the whole
    size. A target stops at ``most`` times its source's size and the rest is shared again by weight:
    in the order of most * size / weight the targets that stop come first, so the level at
    which sharing ends is found with running sums over ranges of that order; the driver sees two sums and the level.
    """
    return _goals(sizes, weights, share, most).select("source", "source_size", "target")


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows): every node draws its left half's blocks without replacement."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    drawn = rng.multivariate_hypergeometric(quotas, int(quotas.sum()) * left // shards, method="marginals")
    return np.concatenate([split_tree(drawn, left, rng), split_tree(quotas - drawn, shards - left, rng)])


def _permutation(n: int, rng: np.random.Generator) -> tuple[int, int]:
    """Factor and summand of a permutation b -> (factor * b + summand) mod n."""
    while True:
        factor = int(rng.integers(1, max(2, n)))
        if gcd(factor, n) == 1:
            return factor, int(rng.integers(0, n))


def _quota_table(spark, quotas: list[tuple[int, int]], shards: int, seed: int) -> DataFrame:
    """For each source its blocks' permutation and where each shard's quota of permuted blocks ends."""
    rng = np.random.default_rng(seed)
    dealt = split_tree(np.array([n for _, n in quotas], dtype=np.int64), shards, rng) if quotas else np.zeros((shards, 0), np.int64)
    rows = [(number, n, *_permutation(n, rng), np.cumsum(dealt[:, j]).tolist()) for j, (number, n) in enumerate(quotas)]
    return spark.createDataFrame(rows, "_of long, _n long, _factor long, _summand long, _ends array<long>")


def mix(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, mark (xxhash64 of the text), size, source_size, target, draws.

    ``draws`` holds a (shard, key) pair for each time the mix takes the row (at most twice); a shard
    is shuffled by reading it in the order of ``key``. A size is the number of words between ASCII
    white space, null has 0. Each source's rows stand in a random order (a seeded hash, so reruns
    agree); the mix takes them all as often as the target holds the whole source, and then from
    the start of that order up to the row whose middle passes the rest of the target. The error is
    half a document, also where a row repeats: each counts for itself. What is drawn is cut into blocks of equal numbers of
    words; the splitting tree deals exact quotas of the blocks of all sources to the shards, and a shard draws its
    quota from the source's permuted blocks, none twice. Sources of a single block go to a shard by their number. Texts without
    words are drawn with whole sources only. An empty table gives an empty one; columns other than doc_id, text and
    source are not read.

    The driver sees the sources that fill two blocks, fewer than there are blocks, however many sources there are.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"], docs["source"], F.xxhash64(text).alias("mark"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    rows = rows.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id", "mark"))
    placed = keep(ordered_totals(rows, ["source"], ["_order", "doc_id", "mark"], {"_before": "size"}), "placed")
    goals = _goals(placed.groupBy("source").agg(F.sum("size").alias("source_size")), (3, 1, 2), 1.5, 2.0)

    wanted = goals.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    per_shard = max(blocks, min(MOST_BLOCKS, int(wanted) // (shards * BLOCK_WORDS)))
    length = max(1, int(wanted) // (shards * per_shard))
    n_blocks = F.greatest(F.ceil(F.ceil("target") / length), F.lit(1)).cast("long")
    several = goals.select("_number", n_blocks.alias("_n")).filter("_n > 1").orderBy("_number").collect()
    table = _quota_table(spark, [(r["_number"], r["_n"]) for r in several], shards, seed)
    goals = goals.join(F.broadcast(table), F.col("_number") == F.col("_of"), "left").withColumnRenamed("source", "_source")  # rows of `several`
    if goals.count() <= BROADCAST_ROWS:
        goals = F.broadcast(goals)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    drawn = placed.join(goals, placed["source"].eqNullSafe(goals["_source"])).withColumn("_whole", whole)
    more = (F.col("_before") + F.col("size") / 2 < F.col("target") - F.col("_whole") * F.col("source_size")) & (F.col("size") > 0)
    times = (F.col("_whole") + F.when(more, 1).otherwise(0)).cast("int")

    def draw(copy: Column) -> Column:
        # The last block takes what a half document adds beyond the target.
        block = F.least(F.floor((copy * F.col("source_size") + F.col("_before")) / length).cast("long"), F.col("_n") - 1)
        at = F.pmod(F.col("_factor") * block + F.col("_summand"), F.col("_n"))
        shard = F.when(F.col("_n").isNull(), F.pmod(F.xxhash64(F.lit(seed + 2), "_number"), F.lit(shards))).otherwise(F.size(F.filter("_ends", lambda end: end <= at)))
        shard = shard.cast("int")
        return F.struct(shard.alias("shard"), F.xxhash64(F.lit(seed + 1), shard, "doc_id", "mark", copy).alias("key"))

    none = F.array().cast("array<struct<shard:int,key:bigint>>")
    draws = F.when(F.col("_times") > 0, F.sort_array(F.transform(F.sequence(F.lit(0), F.col("_times") - 1), draw))).otherwise(none)
    return drawn.withColumn("_times", times).select("doc_id", "source", "mark", "size", "source_size", "target", draws.alias("draws"))


def mixture(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED, placed: bool = False) -> DataFrame:
    """``docs`` as often as the mix takes them; with ``placed`` also columns shard and key (the order in the shard).

    Rows that repeat an id, source and text are taken each for itself; they alone are sorted to be told apart.
    """
    pair = ["doc_id", "source", "mark"]
    mixed = keep(mix(docs, shards, blocks, seed).select(*pair, "draws"), "draws")
    repeated = keep(mixed.groupBy(*pair).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("mark").alias("_mark")), "repeated")
    # The given columns travel inside one, so that no name of theirs meets one of these.
    rows = docs.select("doc_id", "source", F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("mark"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    out = ["_row.*", *(["_take.shard", "_take.key"] if placed else [])]
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("mark") == F.col("_mark"))

    def side(df):
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    def taken(rows, takes, *more):
        takes = takes.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("mark").alias("_mark"), *[F.col(c).alias(f"_{c}") for c in more], F.explode("draws").alias("_take"))
        on = same
        for c in more:
            on = on & (F.col(c) == F.col(f"_{c}"))
        return rows.join(side(keep(takes, "takes")), on).select(*out)

    if repeated.isEmpty():
        return taken(rows, mixed)
    found = taken(rows, mixed.join(side(repeated), same, "left_anti"))

    def numbered(df):
        return keyed_totals(df.join(side(repeated), same, "left_semi").withColumn("_one", F.lit(1)), pair, [], {"nth": "_one"})

    return found.union(taken(numbered(rows), numbered(mixed), "nth"))
