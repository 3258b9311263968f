from listforge.plans import requests as plan
from listforge.sources.schema import REQUEST

ROWS = [
    (1, " Btm ", "North Indian", "3.5", "medium"),
    (2, "Btm", "Cafe", None, "low"),
    (3, "  ", "Cafe", "3", "low"),
    (4, None, "Cafe", "3", "low"),
    (5, "Btm", "\t", "abc", "low"),
    (6, "Btm", "Cafe", "5.5", "super_cheap"),
    (7, "Btm", "Cafe", "-0.1", None),
    (8, "Btm", "Cafe", "nan", "High"),
    (9, "Btm", "Cafe", " 5 ", "high"),
]


def test_valid(spark):
    df = spark.createDataFrame(ROWS, REQUEST)
    assert [tuple(r) for r in plan.requests_valid(df).orderBy("request_id").collect()] == [
        (1, "Btm", "North Indian", 3.5, "medium"), (2, "Btm", "Cafe", 0.0, "low"), (9, "Btm", "Cafe", 5.0, "high")]


def test_rejected(spark):
    df = spark.createDataFrame(ROWS, REQUEST)
    assert {r[0]: r[1] for r in plan.requests_rejected(df).collect()} == {
        3: ["location"], 4: ["location"], 5: ["cuisine", "min_rating"], 6: ["min_rating", "budget"],
        7: ["min_rating", "budget"], 8: ["min_rating", "budget"]}


def test_numeric_thresholds(spark):
    df = spark.createDataFrame([(1, "a", "b", 3.5, "low")], "request_id bigint, location string, cuisine string, min_rating double, budget string")
    assert plan.requests_valid(df).first().min_rating == 3.5


def test_summary(spark):
    df = plan.requests_valid(spark.createDataFrame(ROWS[:1], REQUEST))
    assert plan.requests_summary(df).first().summary == "location='Btm'  cuisine='North Indian'  min_rating=3.5  budget='medium'"


def test_json_bodies_tell_null_from_absent(spark):
    good = '"location": " Btm ", "cuisine": "Cafe", "budget": "low"'
    bodies = [f"{{{good}}}", f'{{{good}, "min_rating": null}}', f'{{{good}, "min_rating": 3}}', f'{{{good}, "min_rating": "3.5"}}', f'{{{good}, "min_rating": true}}',
              f'{{{good}, "min_rating": [1]}}', f'{{{good}, "min_rating": 5.01}}', '{"location": 7, "cuisine": null, "budget": "low"}', "[]", "no json", None]
    df = plan.from_json(spark.createDataFrame(list(enumerate(bodies)), "request_id bigint, body string"))
    got = {r.request_id: (r.min_rating, r.errors) for r in plan.checked(df).collect()}
    everything = (0.0, ["location", "cuisine", "budget"])
    assert got == {0: (0.0, []), 1: (None, ["min_rating"]), 2: (3.0, []), 3: (3.5, []), 4: (1.0, []), 5: (None, ["min_rating"]), 6: (5.01, ["min_rating"]),
                   7: (0.0, ["location", "cuisine"]), 8: everything, 9: everything, 10: everything}
