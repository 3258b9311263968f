import random

import pytest
from pyspark.sql import functions as F

from listforge.operators import suffixes
from listforge.plans import shortlist
from listforge.sources import read_catalog, write_catalog
from tests import samples

PAIR = "kind string, {} string"


def table(spark, texts):
    return spark.createDataFrame(texts, PAIR.format("text"))


def found(spark, queries, index):
    rows = suffixes.texts_holding(spark.createDataFrame(queries, PAIR.format("query")), index).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def brute(queries, texts):
    return {(k, q, t) for k, q in queries for kind, t in texts if kind == k and q and t and q in t}


@pytest.mark.parametrize("part_rows", [1, 7, 40, 100_000])
def test_equals_brute_force(spark, part_rows):
    rng = random.Random(part_rows)
    word = lambda n: "".join(rng.choice("aaab é%_\U0010ffff") for _ in range(rng.randint(1, n)))
    texts = [(kind, word(14)) for kind in ("place", "dish") for _ in range(40)] + [("dish", None), ("dish", "")]
    queries = [(kind, word(4)) for kind in ("place", "dish", "other") for _ in range(40)] + [("dish", "a"), ("place", "zzz"), ("dish", ""), ("dish", None)]
    index = suffixes.suffix_table(table(spark, texts), part_rows)
    assert found(spark, queries, index) == brute(queries, texts)
    if part_rows < 100:
        assert index.bounds.count() > 3


def test_long_texts_and_queries(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HEAD", 5)
    texts = [("d", "abcdefghij"), ("d", "abcdeXghij"), ("d", "xxabcdefgh")]
    queries = [("d", q) for q in ("abcde", "abcdef", "bcdefghij", "cdeXg", "abcdefghijk", "a")]
    assert found(spark, queries, suffixes.suffix_table(table(spark, texts), 4)) == brute(queries, texts)


def test_a_common_suffix_covers_several_parts(spark):
    texts = [("d", f"{i}e") for i in range(300)]  # a third of all suffixes is the same
    index = suffixes.suffix_table(table(spark, texts), 60)
    per_part = {r["part"]: r["count"] for r in index.rows.groupBy("part").count().collect()}
    assert max(per_part.values()) < 300
    assert len(found(spark, [("d", "e")], index)) == 300


def test_empty_dictionary(spark):
    assert found(spark, [("d", "a")], suffixes.suffix_table(table(spark, [("d", None)]))) == set()


def test_shortlists_join_no_grams(spark):
    catalog, asked = samples.catalog(spark), samples.requests(spark)
    text = shortlist.shortlist_batch(asked, catalog)._jdf.queryExecution().executedPlan().toString()
    assert "gram" not in text and "NestedLoop" not in text and "Cartesian" not in text


def test_cells_of_a_published_version_are_built_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "catalog")
    rows = samples.catalog(spark)
    write_catalog(rows, path)
    first = shortlist.published_cells(spark, path)
    asked = samples.requests(spark)
    want = sorted(map(tuple, shortlist.shortlist_batch(asked, rows).select("request_id", "pos", "id").collect()))
    assert sorted(map(tuple, shortlist.shortlist_batch(asked, None, first).select("request_id", "pos", "id").collect())) == want
    with monkeypatch.context() as m:
        m.setattr(shortlist, "best_cells", None)  # a second build would fail
        again = shortlist.published_cells(spark, path, 10)
    assert sorted(map(tuple, shortlist.shortlist_batch(asked, None, again).select("request_id", "pos", "id").collect())) == want
    assert read_catalog(spark, path).count() == rows.count()  # the catalog's own files are as before
    write_catalog(rows.filter("id <= 50"), path)
    newer = shortlist.published_cells(spark, path)
    assert newer.rows.agg(F.max("id")).first()[0] <= 50
    with pytest.raises(ValueError):
        shortlist.shortlist_batch(asked, None, newer, k=41)
