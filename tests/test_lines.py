import csv
import json
import random

import pytest

from listforge.plans import ingest
from listforge.sources import read_raw
from listforge.sources.lines import records


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def cell(rng):
    return rng.choice(["plain", "", "with, comma", 'say "hi"', "two\nlines", 'a "quoted\n\nblank line", too', " \n ", "é😀\n,", '"', '""\n"'])


def write(path, rows, newline="\n"):
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator=newline).writerows([("name", "city", "rate"), *rows])


def test_csv_in_byte_ranges_equals_one_reader(spark, tmp_path, small_ranges):
    rng = random.Random(3)
    want = []
    for k in range(3):
        rows = [(f"{k}-{i} " + cell(rng), cell(rng), rng.choice(["4.1/5", "NEW", ""])) for i in range(150)]
        write(tmp_path / f"part{k}.csv", rows)
        want += rows
    raw = read_raw(spark, str(tmp_path), "csv", positions=True)
    assert raw.columns == ["name", "city", "rate", "_file", "_row"]
    got = [(r.name, r.city or "", r.rate or "") for r in raw.orderBy("_file", "_row").collect()]
    assert got == [tuple(r) for r in want]
    assert [r._row for r in raw.orderBy("_file", "_row").collect()] == list(range(150)) * 3
    whole = read_raw(spark, str(tmp_path), "csv").collect()
    assert sorted((r.name, r.city, r.rate) for r in raw.fillna("").collect()) == sorted((r.name, r.city or "", r.rate or "") for r in whole)


def test_a_large_file_is_many_tasks(spark, tmp_path, small_ranges):
    write(tmp_path / "one.csv", [(f"n{i}\nsecond line", "x", "1") for i in range(400)])
    assert spark.read.text(str(tmp_path / "one.csv")).rdd.getNumPartitions() > 8
    names = [r.name for r in ingest.clean_catalog(read_raw(spark, str(tmp_path / "one.csv"), "csv", positions=True)).orderBy("id").collect()]
    assert names == [f"n{i}\nsecond line" for i in range(400)]


def test_carriage_returns_blank_lines_and_an_open_quote(spark, tmp_path, small_ranges):
    write(tmp_path / "crlf.csv", [("a", "b", "c"), ("d\r\ne", "f", "g")], "\r\n")
    got = read_raw(spark, str(tmp_path / "crlf.csv"), "csv", positions=True).orderBy("_row").collect()
    assert [(r.name, r.city, r.rate) for r in got] == [("a", "b", "c"), ("d\r\ne", "f", "g")]
    (tmp_path / "gaps.csv").write_text('name,city\n\n  \n"x\n\ny",1\n\n z,2')
    got = read_raw(spark, str(tmp_path / "gaps.csv"), "csv", positions=True).orderBy("_row").collect()
    assert [(r._row, r.name, r.city) for r in got] == [(0, "x\n\ny", "1"), (1, " z", "2")]
    (tmp_path / "open.csv").write_text('name,city\na,1\n"b,2\nc,3\n')
    got = records(spark, str(tmp_path / "open.csv")).orderBy("_row").collect()
    assert [r.record for r in got] == ["name,city", "a,1", '"b,2\nc,3']
    (tmp_path / "none.csv").write_text("name,city\n")
    assert read_raw(spark, str(tmp_path / "none.csv"), "csv", positions=True).count() == 0


def test_json_lines_have_positions(spark, tmp_path, small_ranges):
    rows = [{"name": f"n{i}", "rate": i / 10, "city": None if i % 3 else 'a "b'} for i in range(200)]
    (tmp_path / "rows.json").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    raw = read_raw(spark, str(tmp_path / "rows.json"), "json", positions=True)
    assert [(r._row, r.name, r.city) for r in raw.orderBy("_row").collect()] == [(i, r["name"], r["city"]) for i, r in enumerate(rows)]
    assert [r.name for r in ingest.clean_catalog(raw).orderBy("id").collect()] == [f"n{i}" for i in range(200)]


def test_records_that_do_not_fit(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("name,rate\na,1\nb,2,3,4\n")
    raw = read_raw(spark, str(tmp_path / "bad.csv"), "csv", positions=True, schema="name string, rate string")
    assert [(r.name, r._corrupt_record) for r in raw.orderBy("_row").collect()] == [("a", None), ("b", "b,2,3,4")]
    with pytest.raises(ValueError):
        read_raw(spark, str(tmp_path), "orc", positions=True)
