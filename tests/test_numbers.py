import pytest
from pyspark.sql import functions as F

from listforge.functions import numbers
from tests.test_text import run


RATINGS = {
    "4.1/5": 4.1, "4.1 /5": 4.1, " 3.9 / 5 ": 3.9, "NEW": None, "-": None, "": None, None: None, "5": 5.0, "5.0": 5.0, "5.1": None, "-0.1": None,
    "0": 0.0, "nan": None, "inf": None, "4.1f": None, "4d": None, "4_0e-1": 4.0, ".5": 0.5, "5.": 5.0, "1e0": 1.0, "4.1/10": None, "4/5 (12)": 4.0,
    "+3": 3.0, "3 stars": None, "\u0664": 4.0, "4.1/5\nx": None, "\u20034.2\u00a0/ 5": 4.2, "4__1": None, "_4": None,
}
COSTS = {
    "1,200": 1200.0, "\u20b9800": 800.0, "$15": 15.0, "-500": 500.0, "Rs. 500": 0.5, "500-800": 500800.0, "n/a": None, "": None, " ": None, None: None,
    "1.2.3": None, ".": None, "5.": 5.0, "\u0663\u0660\u0660": 300.0, "1e3": 13.0, "0": 0.0, "1 500": 1500.0, "9" * 30: 1e30,
}


def test_rating(spark):
    assert run(spark, list(RATINGS), numbers.clean_rating) == list(RATINGS.values())


def test_cost(spark):
    assert run(spark, list(COSTS), numbers.clean_cost) == list(COSTS.values())


def test_cost_quirks_are_kept(spark):
    assert run(spark, ["-500", "Rs. 500", "500-800"], numbers.clean_cost) == [500.0, 0.5, 500800.0]


@pytest.mark.parametrize("cost,want", [
    (0.0, "low"), (499.99, "low"), (500.0, "medium"), (1500.0, "medium"), (1500.01, "high"), (float("nan"), None), (None, None)])
def test_tiers(spark, cost, want):
    df = spark.createDataFrame([(cost,)], "c double")
    assert df.select(numbers.assign_budget(F.col("c"))).first()[0] == want


def test_display_numbers(spark):
    df = spark.createDataFrame([(4.04, 299.9), (4.25, -1.5), (4.35, 0.0), (0.25, 1.0), (0.35, 7.9), (4.75, 2.0), (5.0, 3.5), (0.0, 0.5), (2.95, 1e6), (None, None)], "r double, c double")
    got = [tuple(r) for r in df.select(numbers.one_decimal(F.col("r")), numbers.whole_number(F.col("c"))).collect()]
    assert got == [(4.0, 299.0), (4.2, -1.0), (4.3, 0.0), (0.2, 1.0), (0.3, 7.0), (4.8, 2.0), (5.0, 3.0), (0.0, 0.0), (3.0, 1e6), (None, None)]


def test_one_decimal_of_all_hundredths(spark):
    df = spark.range(501).select((F.col("id") / 100).alias("r"))
    assert [r[1] for r in df.select("r", numbers.one_decimal(F.col("r"))).collect()] == [float(f"{i / 100:.1f}") for i in range(501)]
