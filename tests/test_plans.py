"""The plans Spark is meant to choose."""

import pytest
from pyspark.sql import functions as F

from checks.queries import all_queries
from listforge.plans import shortlist
from listforge.plans.ingest import clean
from listforge.sources import read_catalog, write_catalog
from tests import samples

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("catalog"))
    write_catalog(samples.catalog(spark), path)
    return read_catalog(spark, path)


def test_single_request_is_pushed_down(catalog):
    text = plan(shortlist.shortlist_one(catalog, "btm", "cafe", 3.0, "medium"))
    assert "EqualTo(budget,medium)" in text and "GreaterThanOrEqual(rating,3.0)" in text
    assert "TakeOrderedAndProject" in text and text.count("Exchange SinglePartition") <= 1


def test_cells_are_cut_before_the_shuffle(catalog):
    text = plan(shortlist.best_cells(catalog))
    assert text.count("WindowGroupLimit") == 4 and "Partial" in text
    assert "IsNotNull(rating)" in text and "IsNotNull(location)" in text


def test_option_list_reads_one_column(catalog):
    text = plan(catalog.select(F.explode("cuisines").alias("v")).distinct())
    assert "ReadSchema: struct<cuisines:array<string>>" in text


def test_cleaning_parses_once(spark):
    raw = spark.createDataFrame([("a", "b", "c", "4/5", "1")], "name string, location string, cuisines string, rate string, cost string")
    text = plan(clean(raw))
    assert text.count("try_cast") == 2


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_no_query_pairs_everything_or_leaves_the_jvm(spark, name):
    text = plan(all_queries()[name](spark, SF))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert forbidden not in text


def test_csv_ranges_are_small_and_bounded():
    from checks.queries import range_bytes

    assert range_bytes(0) == range_bytes(1 << 20) == 16 << 10
    assert all(-(-size // range_bytes(size)) <= 256 for size in (5 << 20, 1 << 30, (1 << 33) + 1))
