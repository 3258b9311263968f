import pytest
from pyspark.sql import functions as F

from listforge.operators.predicates import cuisine_matches, location_matches
from listforge.plans import facts, quality, shortlist
from listforge.sources import read_catalog, write_catalog
from listforge.sources.catalog import catalog_path
from listforge.sources.schema import CATALOG
from listforge.sources.signatures import files_holding
from tests import samples


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("published") / "c")
    write_catalog(samples.catalog(spark, n=600).repartitionByRange(6, "location", "id"), path)
    return path


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.mark.parametrize("location,cuisine", [
    ("btm", None), ("BTM", "indian"), ("a", "i"), ("5th", "fast food"), ("nagar", "Chinese"), ("0% r", None), ("nowhere", "cafe"), (None, "alien"), ("a_b street", "x")])
def test_skipped_files_hold_no_match(spark, published, location, cuisine):
    whole, some = read_catalog(spark, published), read_catalog(spark, published, location=location, cuisine=cuisine)
    fits = lambda df: df.filter((location_matches(location) if location else F.lit(True)) & (cuisine_matches(cuisine) if cuisine else F.lit(True)))
    assert ids(fits(some)) == ids(fits(whole))


def test_few_files_are_read(spark, published):
    assert len(read_catalog(spark, published).inputFiles()) == 6
    assert len(read_catalog(spark, published, location="A_B Street").inputFiles()) <= 2
    assert len(read_catalog(spark, published, location="zzz").inputFiles()) in (0, 6) and read_catalog(spark, published, location="zzz").count() == 0
    assert len(read_catalog(spark, published, location="t").inputFiles()) > 2
    one = shortlist.shortlist_published(spark, published, "a_b", "indian", budget="medium")
    assert [r.id for r in one.orderBy("pos").collect()] == samples.brute_shortlist(samples.catalog_rows(n=600), "a_b", "indian", 0.0, "medium")


def test_tables_without_signatures_are_read_whole(spark, tmp_path):
    path = str(tmp_path / "foreign")
    samples.catalog(spark).write.parquet(path)
    assert files_holding(spark, path, "btm") is None
    assert ids(read_catalog(spark, path, location="btm")) == ids(samples.catalog(spark))


def reports(found):
    return [sorted(map(tuple, df.collect()), key=str) for df in (
        facts.report_from_facts(found), facts.rating_summary_from_facts(found), facts.null_rates_from_facts(found), facts.budget_counts_from_facts(found), facts.top_locations_from_facts(found))]


def rows_reports(df):
    return [sorted(map(tuple, x.collect()), key=str) for x in (
        quality.quality_report(df), quality.rating_summary(df), quality.null_rates(df), quality.budget_counts(df), quality.top_locations(df))]


def test_facts_of_an_append_read_the_new_files_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    rows = samples.catalog_rows(n=300)
    write_catalog(spark.createDataFrame(rows, CATALOG).repartition(4), path)
    assert reports(facts.facts(spark, path)) == rows_reports(read_catalog(spark, path))
    read = []
    write = facts._write
    monkeypatch.setattr(facts, "_write", lambda df, folder: (read.append(len(df.inputFiles())), write(df, folder)))
    facts.facts(spark, path)
    assert read == []  # nothing new
    # Repeated ids, a wrong tier and a rating out of range come in two files.
    more = [(*r[:4], 7.5, r[5], "huge") for r in rows[:30]] + [(None, "n", None, [], None, None, None)]
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CATALOG.fields)
    spark.createDataFrame(more, shape).repartition(2).write.mode("append").parquet(catalog_path(spark, path))
    assert reports(facts.facts(spark, path)) == rows_reports(read_catalog(spark, path))
    assert read == [2]
    assert read_catalog(spark, path).count() == 331  # facts are no rows


def test_facts_left_by_a_broken_run_count_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    write_catalog(samples.catalog(spark, n=100).repartition(2), path)
    files = spark.read.parquet(catalog_path(spark, path)).inputFiles()
    from listforge.sources.catalog import canonical
    stored = f"{catalog_path(spark, path)}/_facts"
    rows = canonical(spark.read.parquet(files[0]), True, keep_file=True)
    facts._write(rows, stored)
    import shutil
    shutil.rmtree(f"{stored}/files")
    assert reports(facts.facts(spark, path)) == rows_reports(read_catalog(spark, path))


def test_facts_of_an_empty_catalog(spark, tmp_path):
    path = str(tmp_path / "c")
    write_catalog(samples.catalog(spark).limit(0), path)
    assert {r.rule for r in facts.report_from_facts(facts.facts(spark, path)).collect() if r.failed} == {r.rule for r in quality.quality_report(read_catalog(spark, path)).collect() if r.failed}
