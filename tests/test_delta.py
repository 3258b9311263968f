import random

import pytest
from pyspark.sql import functions as F

from listforge.plans import delta, identity, shortlist
from listforge.sources.schema import CATALOG
from listforge.sources.shared import keep
from tests import samples


def entries(state):
    rows = state.select("at", "offers", "budget", "cell_pos", "id", "rating", "listing.name", "whole").collect()
    assert len(rows) == len(set(rows))
    return rows


def held(rows, k):
    return sorted(tuple(r)[:-1] for r in rows if r.cell_pos <= k)


def changed(rows, seed, gone=0.2, came=20):
    rng = random.Random(seed)
    left = [list(r) for r in rows if rng.random() > gone]
    for r in left:
        if rng.random() < 0.2:
            r[4] = rng.choice([None, 1.0, 3.3, 4.95])
        if rng.random() < 0.1:
            r[2] = rng.choice(samples.PLACES)
    top = max(r[0] for r in rows)
    new = [(top + i, *r[1:]) for i, r in enumerate(rng.choices(rows, k=came), 1)]
    return [tuple(r) for r in left] + new


@pytest.mark.parametrize("k,slack", [(1, 0), (3, 2), (5, 40)])
def test_kept_up_state_equals_a_new_one(spark, k, slack):
    rows = samples.catalog_rows(n=250)
    state = keep(delta.cell_state(spark.createDataFrame(rows, CATALOG), k, slack))
    for step in range(3):
        newer = changed(rows, step)
        old, new = spark.createDataFrame(rows, CATALOG), spark.createDataFrame(newer, CATALOG)
        removed, added = delta.changes(old, new)
        state = delta.update_cells(state, removed, added, new, k, slack)
        got, want = entries(state), entries(delta.cell_state(new, k, slack))
        assert held(got, k) == held(want, k)
        # What the state holds beyond k is right as well, as far as it goes.
        best = {(*r[:3], r.cell_pos): r.id for r in entries(delta.cell_state(new, 250, 0))}
        assert all(best[(*r[:3], r.cell_pos)] == r.id for r in got)
        rows = newer


def test_only_emptied_cells_read_the_catalog(spark, monkeypatch):
    rows = [(i, "n", "Btm", ["Cafe"], 5.0 - i / 100, 300.0, "low") for i in range(1, 101)] + [(200, "n", "Btm", ["Tea"], 4.0, 300.0, "low")]
    catalog = keep(spark.createDataFrame(rows, CATALOG))
    state = keep(delta.cell_state(catalog, 5, 5))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    none = catalog.limit(0)
    with monkeypatch.context() as m:
        m.setattr(delta, "_with_whole", None)  # a refill would fail
        fewer = delta.update_cells(state, ids(1, 2, 3), none, None, 5, 5)
        assert [r.id for r in fewer.filter("offers = 'cafe'").orderBy("cell_pos").collect()] == [4, 5, 6, 7, 8, 9, 10]
        gone = delta.update_cells(state, ids(200), none, None, 5, 5)  # a cell that is known to be whole ends
        assert gone.filter("offers = 'tea'").count() == 0
    left = catalog.filter("id not in (4, 5, 6)")
    again = delta.update_cells(fewer, ids(4, 5, 6), none, left.filter("id > 3"), 5, 5)
    assert [r.id for r in again.filter("offers = 'cafe'").orderBy("cell_pos").collect()] == [7, 8, 9, 10, 11, 12, 13, 14, 15, 16]


def test_cells_of_a_state_answer_shortlists(spark):
    catalog, asked = samples.catalog(spark), samples.requests(spark)
    cells = delta.cells_of(keep(delta.cell_state(catalog)))
    plain = lambda df: sorted(map(tuple, df.select("request_id", "pos", "id").collect()))
    assert plain(shortlist.shortlist_batch(asked, None, cells)) == plain(shortlist.shortlist_batch(asked, catalog))


RAW = "seq long, name string, city string, cuisine string, rate string, cost string"


def raw_rows(*names):
    return [(i, n, "btm", "cafe, tea", "4/5", "300") for i, n in enumerate(names)]


def ingest(spark, id_map, rows):
    catalog, following = identity.stable_ids(spark.createDataFrame(rows, RAW), id_map, ["seq"])
    return {r.id: r.name for r in catalog.collect()}, following


def test_ids_stay_and_are_never_given_twice(spark):
    ids, known = ingest(spark, spark.createDataFrame([], identity.ID_MAP), raw_rows("a", "b", "b", "c", "b"))
    assert ids == {1: "a", 2: "b", 3: "b", 4: "c", 5: "b"}
    ids, known = ingest(spark, known, raw_rows("d", "b", " a ", "b", "e"))
    assert ids == {1: "a", 2: "b", 3: "b", 6: "d", 7: "e"}
    assert sorted(r.id for r in identity.tombstones(known).collect()) == [4, 5]
    ids, known = ingest(spark, known, raw_rows("c", "f"))
    assert ids == {4: "c", 8: "f"}  # a row that comes back is the row it was
    ids, known = ingest(spark, known, raw_rows())
    assert ids == {} and known.count() == 8
    assert ingest(spark, known, raw_rows("g"))[0] == {9: "g"}


def test_fingerprints_keep_values_apart(spark):
    rows = [("a1:b", None, ["x"], 4.0, None, None), ("a", None, ["x"], 4.0, None, None), ("a", "x", [], 4.0, None, None), ("a", None, ["x", ""], 4.0, None, None),
            ("a", None, ["x"], None, 4.0, None), ("a", None, ["x"], None, None, "4.0"), ("a", "-", ["x"], 4.0, None, None), ("a", "", ["x"], 4.0, None, None)]
    df = spark.createDataFrame(rows, "name string, location string, cuisines array<string>, rating double, cost_for_two double, budget string")
    assert df.select(identity.fingerprint().alias("p")).distinct().count() == len(rows)


def test_one_row_repeated_very_often(spark):
    rows = [(i, "same", "btm", "cafe", "4/5", "300") for i in range(900)] + [(i, f"n{i}", "btm", "cafe", "4/5", "300") for i in range(900, 1000)]
    ids, known = ingest(spark, spark.createDataFrame([], identity.ID_MAP), rows)
    assert sorted(ids) == list(range(1, 1001))
    again, _ = ingest(spark, known, rows[500:])
    assert sorted(i for i, n in again.items() if n == "same") == list(range(1, 401)) and {i for i in again if again[i] != "same"} == set(range(901, 1001))
    assert known.agg(F.max("nth")).first()[0] == 900
