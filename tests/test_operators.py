import random

from pyspark.sql import functions as F

from listforge.operators.numbering import in_order, keyed_totals, number, number_rows, running_total
from listforge.operators.spread import spread_join
from listforge.operators.substring import substring_pairs
from listforge.operators.topk import best_per_hot_key, best_per_key


def test_numbers_are_dense_over_many_partitions(spark):
    keys = random.Random(3).sample(range(10_000), 1000)
    df = spark.createDataFrame([(k,) for k in keys], "k int").repartition(7)
    got = {r.k: r.id for r in number_rows(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys), 1)}


def test_numbers_with_one_hot_key(spark):
    df = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(900)], "k int, v int").repartition(5)
    # Small partitions would be merged and hide the spread.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ordered = in_order(df, "k")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = ordered.groupBy(F.shiftright("_seq", 33)).count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 600  # 600 rows share a key
    rows = number(ordered, "id").collect()
    assert sorted(r.id for r in rows) == list(range(1, 901))
    by_id = [r.k for r in sorted(rows, key=lambda r: r.id)]
    assert by_id == sorted(by_id)


def test_numbers_of_nothing(spark):
    assert number_rows(spark.createDataFrame([], "k int"), "k").collect() == []


def test_running_total(spark):
    rows = [(i, i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, n bigint").repartition(6)
    got = {r.k: r.upto for r in running_total(in_order(df, "k"), "n", "upto").collect()}
    total, want = 0, {}
    for k, n in rows:
        total += n
        want[k] = total
    assert got == want


def test_keyed_totals_carry_a_hot_key_over_partitions(spark):
    rng = random.Random(11)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None, "zz"]), rng.choice([1.5, 2.5, None]), rng.randint(0, 9), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, mark double, n bigint, row int").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = keyed_totals(df.withColumn("one", F.lit(1)), ["k"], [F.desc("mark"), "row"], {"upto": "n", "rows": "one"})
    found = {r.row: (r.upto, r.rows) for r in got.collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total, want = {}, {}
    for k, mark, n, row in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[3])):
        a, b = total.get(k, (0, 0))
        total[k] = want[row] = (a + n, b + 1)
    assert found == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(_part" in plan  # rows are numbered per partition and key, never per key alone


def test_keyed_totals_of_repeated_rows_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 1)] * 500, "k string, n bigint").repartition(5)
    assert sorted(r.upto for r in keyed_totals(df, ["k"], ["n"], {"upto": "n"}).collect()) == list(range(1, 501))
    assert keyed_totals(df.limit(0), ["k"], ["n"], {"upto": "n"}).collect() == []


def test_substring_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("aabc é%_") for _ in range(rng.randint(1, n)))
    texts = sorted({word(12) for _ in range(150)})
    queries = sorted({word(5) for _ in range(120)} | {"zzz", "a", "é"})
    got = substring_pairs(
        spark.createDataFrame([(q,) for q in queries], "query string"),
        spark.createDataFrame([(t,) for t in [*texts, ""]], "text string"),
    ).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == {(q, t) for q in queries for t in texts if q in t}


def _best(rows, k):
    groups = {}
    for key, rating, id_ in set(rows):
        groups.setdefault(key, []).append((-rating, id_))
    return {(key, pos, id_) for key, ids in groups.items() for pos, (_, id_) in enumerate(sorted(ids)[:k], 1)}


def test_best_per_key(spark):
    rng = random.Random(7)
    ratings = {i: rng.choice([1.0, 2.0, 3.0]) for i in range(200)}
    # Copies of a listing under the same key, and a key with most of the rows.
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), ratings[i], i) for i in (rng.randrange(200) for _ in range(1500))]
    df = spark.createDataFrame(rows, "key string, rating double, id int").repartition(9)
    for best in (best_per_key, best_per_hot_key):
        got = {(r.key, r.pos, r.id) for r in best(df, ["key"], 10).collect()}
        assert got == _best(rows, 10)


def test_spread_join_equals_plain_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 20}") for i in range(400)], "id int, key string")
    per_key = spark.createDataFrame([("hot", 1), ("k0", 2), ("k2", 3), ("unused", 4)], "key string, v int")
    want = sorted(tuple(r) for r in rows.join(per_key, "key", "left").collect())
    for slice_rows in (10, 150, 10_000):
        got = spread_join(rows, per_key, ["key"], "id", slice_rows=slice_rows)
        assert got.columns == ["key", "id", "v"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_small_partner_table_leaves_the_rows_where_they_are(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else None if i % 3 else f"k{i % 20}") for i in range(400)], "id int, key string").repartition(5)
    per_key = spark.createDataFrame([("hot", 1), ("k0", 2), ("unused", 4)], "key string, v int")
    got = spread_join(rows, per_key, ["key"], "id", small=True)
    assert got.withColumn("at", F.spark_partition_id()).select("at").distinct().count() == 5
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.join(per_key, "key", "left").collect()), key=str)
