import re

import pytest
from pyspark.sql import functions as F

from listforge.functions import text

PROBES = [
    "btm layout", "1st block", "o'brien's bar", "jp-nagar", "  MG   road\t\n", " x ", "　café  ÉCOLE ",
    "", " ", "a,b", "x1y2z3", "ÀÉÎ öäü", "#tag", "brand#1", "hello_world", "ab\x1c cd\x1f", "日本 food", "ǆ", "it's 5pm", "A.B.C", "(new) place", "ßx aßb", "ﬁsh", "ΣΑΣ", "5 x", "a  b",
]


def run(spark, values, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_strip(spark):
    assert run(spark, PROBES, text.strip) == [p.strip() for p in PROBES]


def test_collapse(spark):
    assert run(spark, PROBES, text.collapse) == [re.sub(r"\s+", " ", p) for p in PROBES]


def test_title(spark):
    assert run(spark, PROBES, text.title) == [p.title() for p in PROBES]


@pytest.mark.parametrize("value,want", [
    ("btm layout", "Btm Layout"), ("  MG   road\t\n", "Mg Road"), ("o'brien's  bar", "O'Brien'S Bar"), ("1st block", "1St Block"), ("", None), (" \t", None), (None, None),
    ("jp-nagar", "Jp-Nagar"), ("\u00c0\u00c9 \u00f6", "\u00c0\u00e9 \u00d6")])
def test_normalize_location(spark, value, want):
    assert run(spark, [value], text.normalize_location) == [want]


@pytest.mark.parametrize("value,want", [
    ("North Indian, Chinese, Biryani", ["North Indian", "Chinese", "Biryani"]), (" a ,, b , ", ["A", "B"]), (",", []), (" , , ", []), ("", []), (None, []),
    ("cafe,cafe", ["Cafe", "Cafe"]), ("x ,\ty", ["X", "Y"]), ("a, ,b", ["A", "B"]), ("o'neil bar ,2nd cup", ["O'Neil Bar", "2Nd Cup"]),
    ("a,\u2003b", ["A", "B"]), ("\u00c9,\u00e9 , \u00f1", ["\u00c9", "\u00c9", "\u00d1"]),
])
def test_split_cuisines(spark, value, want):
    assert run(spark, [value], text.split_cuisines) == [want]


@pytest.mark.parametrize("query,hit", [("btm", True), ("BTM L", True), ("%", False), ("b_m", False), ("layout x", False)])
def test_contains_is_literal(spark, query, hit):
    assert run(spark, ["Btm Layout"], lambda c: text.contains_text(c, F.lit(query))) == [hit]


def test_contains_null(spark):
    assert run(spark, [None], lambda c: text.contains_text(c, F.lit("a"))) == [False]
