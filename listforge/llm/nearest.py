"""Nearest neighbours by a block matrix join with int8 products and error bounds."""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Vectors of one block of queries and of candidates.
QUERY_BLOCK, BLOCK = 512, 8192
#: Slices that a query's block results are merged in before the last merge.
SLICES = 16


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.stack([table.column(c).to_numpy() for c in ("id", "mark")], 1)
    flat = table.column("vector").combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return ids, flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, their scales, and the length of what rounding took away."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = 1.0  # only numbers too small for a scale
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of one vector to many, summed in the order of the components."""
    total = np.zeros(len(b))
    for j in range(len(a)):
        total += (a[j] - b[:, j]) ** 2
    return np.sqrt(total)


def _tile(k: int):
    def run(left, right):
        """The k nearest of one block of candidates for each query of one block."""
        out = ([], [], [], [])
        if left.num_rows and right.num_rows:
            (ids, x), (cids, y) = _matrix(left), _matrix(right)
            (qa, sa, ea), (qb, sb, eb) = _quantised(x), _quantised(y)
            # Products of int8 in float32 are exact up to 1040 components, in float64 far beyond.
            kind = np.float32 if x.shape[1] <= 1040 else np.float64
            product = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64) * sa[:, None] * sb[None, :]
            na, nb = (((q.astype(np.float64) ** 2).sum(1) * s**2 for q, s in ((qa, sa), (qb, sb))))
            near = np.sqrt(np.maximum(na[:, None] + nb[None, :] - 2 * product, 0))
            # Rounding of the float sums is far below this share of the lengths.
            slack = ea[:, None] + eb[None, :] + 1e-6 * (np.sqrt(na)[:, None] + np.sqrt(nb)[None, :]) + 1e-300
            for i, query in enumerate(ids):
                others = np.flatnonzero((cids != query).any(1))
                if not len(others):
                    continue
                upper = near[i, others] + slack[i, others]
                reach = np.partition(upper, k - 1)[k - 1] if len(others) > k else np.inf
                maybe = others[near[i, others] - slack[i, others] <= reach]
                exact = _distances(x[i], y[maybe])
                for d, c in heapq.nsmallest(k, zip(exact.tolist(), cids[maybe, 0].tolist(), strict=True)):
                    out[0].append(int(query[0]))
                    out[1].append(int(query[1]))
                    out[2].append(c)
                    out[3].append(d)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "query_mark": pa.array(out[1], pa.int64()), "vec_id": pa.array(out[2], pa.int64()), "score": pa.array(out[3], pa.float64())})
    return run


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best per key; every map task cuts to k before the shuffle."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("score", "vec_id"))).filter(F.col("rank") <= k)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (id, vector of doubles) that take part: no null id or vector, no null or non-finite component, not all zero."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).filter(fine)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` by Euclidean distance for each row of ``queries``: query_id, rank, vec_id, score.

    Both tables have columns vec_id and embedding. A query is never its own neighbour; ties go to smaller ids; with fewer
    candidates all are returned. Vectors of another length than a query's are no candidates for it. An id may repeat
    with different vectors: each is a query and a candidate of its own, also for the others of its id (a repeated query
    id then has its ranks once per vector). Rows that repeat id and vector count once. Empty tables give an empty one, and
    columns with other names are not read.

    Every block of queries meets every block of candidates in one task, at most QUERY_BLOCK by about BLOCK
    vectors. int8 products give each distance up to a bound; only candidates whose lower bound reaches the k-th
    smallest upper bound are computed in double precision. Results of blocks are merged in two steps.
    """
    def numbered(df):
        # -0.0 is 0.0 to a comparison, and the mark tells the vectors of one id apart.
        same = df.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))).dropDuplicates(["id", "vector"])
        return same.withColumns({"length": F.size("vector"), "mark": F.xxhash64("vector")})

    found, asked = keep(numbered(usable(vectors)), "vectors"), keep(numbered(usable(queries)), "queries")
    blocks, query_blocks = (max(1, -(-df.count() // n)) for df, n in ((found, BLOCK), (asked, QUERY_BLOCK)))

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = asked.select("id", "mark", "vector", "length", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("_q"), every(blocks).alias("_c"))
    right = found.select("id", "mark", "vector", "length", every(query_blocks).alias("_q"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("_c"))
    tiles = left.groupBy("length", "_q", "_c").cogroup(right.groupBy("length", "_q", "_c")).applyInArrow(_tile(k), "query_id bigint, query_mark bigint, vec_id bigint, score double")
    sliced = _best(keep(tiles, "tiles").withColumn("_slice", F.pmod(F.xxhash64("vec_id"), F.lit(SLICES))), ["query_id", "query_mark", "_slice"], k)
    return _best(sliced.drop("rank", "_slice"), ["query_id", "query_mark"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
