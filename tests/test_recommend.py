import json

import pytest
from pyspark.sql import functions as F

from listforge.functions import messages
from listforge.plans import recommend, scoring, shortlist, views
from listforge.sources import write_payload
from listforge.sources.schema import CATALOG, RESPONSE
from listforge.sources.shared import keep
from tests import samples


def answer(recs, summary="Top 5 recommendations"):
    return json.dumps({"summary": summary, "recommendations": [
        {"restaurant_id": i, "rank": rank, "explanation": text} for i, rank, text in recs]})


GOOD = answer([(1, 1, "fine")])
STATUS = [
    (GOOD, "ok"), ('{"summary": "x", "recommendations": []}', "ok"), (f"  {GOOD}\n", "ok"),
    ('{"summary": "x", "recommendations": [], "more": [1]}', "ok"),
    (answer([("7", 1.0, "x")]), "ok"), (answer([(True, "2", "x")]), "ok"),
    (answer([(1, 2**40, "x")]), "ok"), (answer([(2**70, 1, "x")]), "ok"), (answer([(-(2**70), 2**80, "x")]), "ok"),
    (GOOD[:-1] + ', "confidence": NaN}', "ok"), (GOOD[:-1] + ', "summary": "again"}', "ok"), (GOOD[:-1] + ', "summary": 5}', "retry"),
    (GOOD[:-1] + ', "more": {"x": [Infinity, -Infinity]}}', "ok"), (GOOD[:-1] + ', "confidence": NaN} bye', "retry"), (f"[{GOOD[:-1]}, \"a\": NaN}}]", "stop"),
    ('{"summary": "x", "recommendations": [{"rank": 1, "rank": 2, "restaurant_id": 1, "explanation": "x"}]}', "ok"),
    ('{"summary": "x", "recommendations": [{"rank": NaN, "restaurant_id": 1, "explanation": "x"}]}', "retry"), ("NaN", "stop"),
    ("plain text", "retry"), ("", "retry"), (GOOD + " bye", "retry"), (GOOD + "}", "retry"), (GOOD + "]", "retry"),
    (GOOD + "," + GOOD, "retry"), (GOOD + '}, "b": {"a": 1', "retry"), (GOOD + "], [1", "retry"), ("{'summary': 1}", "retry"),
    ('{"summary": "x"}', "retry"), ('{"recommendations": []}', "retry"), ('{"summary": 1, "recommendations": []}', "retry"),
    ('{"summary": "x", "recommendations": null}', "retry"), ('{"summary": "x", "recommendations": {"a": 1}}', "retry"),
    ('{"summary": "x", "recommendations": [1]}', "retry"), ('{"summary": "x", "recommendations": [null]}', "retry"),
    ('{"summary": "x", "recommendations": [{"restaurant_id": 1, "explanation": "x"}]}', "retry"),
    (answer([(1.5, 1, "x")]), "retry"), (answer([("one", 1, "x")]), "retry"), (answer([(1, 1, None)]), "retry"), (answer([(1, 1, 5)]), "retry"),
    ("[]", "stop"), (f"[{GOOD}]", "stop"), ("null", "stop"), ("5", "stop"), ('"text"', "stop"), (None, "stop"),
]


def test_judged(spark):
    df = spark.createDataFrame([(i, 0, raw, None) for i, (raw, _) in enumerate(STATUS)], RESPONSE)
    got = {r.request_id: r.status for r in scoring.judged(df).collect()}
    assert [(STATUS[i][0], got[i]) for i in range(len(STATUS))] == STATUS


def test_judged_error_rows_stop(spark):
    df = spark.createDataFrame([(1, 0, GOOD, "timeout")], RESPONSE)
    assert scoring.judged(df).first().status == "stop"


def test_coerced_numbers(spark):
    df = spark.createDataFrame([(1, 0, answer([("7", 1.0, "x"), (True, "2", "y")]), None)], RESPONSE)
    recs = scoring.judged(df).first().recommendations
    assert [(r.restaurant_id, r.rank) for r in recs] == [(7, 1), (1, 2)]


def test_wide_numbers_and_repeated_keys(spark):
    rows = [answer([(2**70, 2**40, "x"), (5, 2**90, "y")]), '{"summary": "a", "summary": "b", "recommendations": [{"rank": 1, "rank": 2, "restaurant_id": 3, "explanation": "x"}]}']
    got = scoring.judged(spark.createDataFrame([(i, 0, raw, None) for i, raw in enumerate(rows)], RESPONSE)).orderBy("request_id").collect()
    assert [(r.restaurant_id, r.rank) for r in got[0].recommendations] == [(2**63 - 1, 2**40), (5, 2**63 - 1)]
    assert got[1].summary == "b" and [(r.restaurant_id, r.rank) for r in got[1].recommendations] == [(3, 2)]


@pytest.mark.parametrize("attempts,want", [
    ([(0, GOOD)], 0), ([(0, "no"), (1, GOOD)], 1), ([(0, "no"), (1, "no"), (2, GOOD)], 2), ([(0, "no"), (1, "no"), (2, "no")], None),
    ([(0, None), (1, GOOD)], None), ([(0, "[]"), (1, GOOD)], None), ([(0, "no"), (1, "null"), (2, GOOD)], None),
    ([(0, "no"), (1, "no"), (2, "no"), (3, GOOD)], None), ([(7, GOOD)], None), ([(1, GOOD), (0, "no"), (2, "[]")], 1)])
def test_first_valid_attempt(spark, attempts, want):
    df = spark.createDataFrame([(1, n, raw, None) for n, raw in attempts], RESPONSE)
    assert [r.attempt for r in scoring.first_valid_attempt(df).collect()] == ([] if want is None else [want])


# Ids 1..8 match in this order (rating falls); 2 and 4 are clones of 1 and 3.
CATALOG_ROWS = [
    (1, "Alpha", "Btm", ["Cafe", "North Indian"], 4.9, 700.0, "medium"), (2, " ALPHA ", "Btm", ["Cafe"], 4.8, 0.0 + 650.7, "medium"),
    (3, "Beta", "Btm", ["Cafe"], 4.7, 600.0, "medium"), (4, "beta", "Btm", ["Cafe"], 4.6, 1500.0, "medium"),
    (5, "Gamma", "Btm", ["Cafe"], 4.0, 500.0, "medium"), (6, "Delta", "Btm", ["Cafe"], 3.9, 900.0, "medium"),
    (7, "Epsilon", "Btm", ["Cafe"], 3.8, 800.0, "medium"), (8, "Zeta", "Btm", ["Cafe"], 3.7, 750.0, "medium"),
    (9, "Other", "Mg Road", ["Cafe"], 5.0, 700.0, "medium")]


@pytest.fixture(scope="module")
def ask(spark):
    catalog = spark.createDataFrame(CATALOG_ROWS, CATALOG)
    cells = keep(shortlist.best_cells(catalog))

    def run(responses, location="btm", **options):
        request = spark.createDataFrame([(1, location, "CAFE", 0.0, "medium")], samples.REQUEST_SCHEMA)
        rows = [(1, *r) if len(r) == 3 else (1, *r, None) for r in responses]
        return keep(recommend.answers(request, cells, spark.createDataFrame(rows, RESPONSE), **options))

    return run


def items(df):
    return [(r.rank, r.id) for r in recommend.recommend_items(df).orderBy("rank", "rec_pos").collect()]


def test_scored(ask):
    got = ask([(0, answer([(6, 2, "AI: rated 3.0"), (9, 1, "elsewhere"), (3, 1, "b"), (77, 5, "none"), (4, 3, "clone")], "Top 5 recommendations"))])
    assert got.first().kind == "scored" and items(got) == [(1, 3), (2, 6)]
    assert [(r.rec_pos, r.restaurant_id) for r in recommend.valid_recs(got).orderBy("rec_pos").collect()] == [(1, 6), (3, 3), (5, 4)]
    assert sorted((r.rec_pos, r.restaurant_id) for r in recommend.hallucinated_recs(got).collect()) == [(2, 9), (4, 77)]
    assert recommend.recommend_summary(got).first()[1:] == (2, "top two recommendations")
    explained = {r.id: r.explanation for r in recommend.recommend_items(got).collect()}
    assert explained == {3: "b", 6: "rated 3"}


def test_only_five_known_ids_count(ask):
    got = ask([(0, answer([(i, n, "x") for n, i in enumerate([99, 8, 7, 6, 5, 3, 1], 1)]))])
    assert [i for _, i in items(got)] == [8, 7, 6, 5, 3]


def test_repeated_id_and_odd_ranks(ask):
    got = ask([(0, answer([(5, 9, "x"), (5, 1, "y"), (6, 9, "z"), (7, -2, "w")]))])
    assert items(got) == [(-2, 7), (9, 5), (9, 6)]


def test_no_known_id_is_still_an_answer(ask):
    got = ask([(0, answer([(99, 1, "x")], "3 matches")), (1, answer([(5, 1, "x")]))])
    assert items(got) == [] and recommend.recommend_summary(got).first()[1:] == (0, "3 matches")


def test_second_attempt(ask):
    got = ask([(0, "Oops, no JSON"), (1, answer([(5, 1, "Perfect match.")], "Here is the top pick after retry."))])
    assert items(got) == [(1, 5)] and got.first().summary == "Here is the top pick after retry."


def test_unavailable(ask):
    got = ask([])
    assert got.first().kind == "unavailable" and items(got) == [(1, 1), (3, 3), (5, 5)]  # clones fall out, ranks stay
    assert {r.explanation for r in recommend.fallback_recs(got).collect()} == {"No AI explanation available."}
    assert recommend.fallback_recs(got).count() == 5


def test_failed(ask):
    got = ask([(0, "no"), (1, "no"), (2, "no")])
    assert got.first().kind == "failed" and items(got) == [(1, 1), (3, 3), (5, 5)]
    said = {r.restaurant_id: r.explanation for r in recommend.fallback_recs(got).collect()}
    assert said[5] == "Highest rated match: 4.0 stars."
    assert {r.id: r.explanation for r in recommend.recommend_items(got).collect()}[5] == "Highest rated match: 4 stars."


def test_outer_error(ask):
    got = ask([(None, None, "no such column")])
    assert (got.first().kind, got.first().summary) == ("error", "Our AI service encountered an error.")
    assert items(got) == []


def test_empty_shortlist_wins(ask):
    got = ask([(0, GOOD)], location="NowhereCity")
    assert got.first().kind == "empty" and "NowhereCity" in got.first().summary
    assert recommend.recommend_payload(got).first()["items"] == []
    assert [tuple(r)[1:] for r in recommend.fallback_recs(got).collect()] == [("empty", None, None, None)]


def test_payload_and_sink(ask, spark, tmp_path):
    got = ask([(0, answer([(2, 1, "x")], "top 5 matches"))])
    write_payload(recommend.recommend_payload(got), str(tmp_path / "p"))
    doc = json.loads(spark.read.text(str(tmp_path / "p")).first()[0])
    assert doc == {"request_id": 1, "summary": "one match", "items": [
        {"name": " ALPHA ", "cuisines": ["Cafe"], "rating": 4.8, "cost_for_two": 650.0, "explanation": "x", "rank": 1}]}


def test_views(ask):
    got = ask([(0, answer([(1, 1, "x"), (3, 2, "x"), (6, 3, "x"), (5, 4, "x")]))])
    order = lambda df: [r.id for r in df.orderBy("pos").collect()]
    assert order(views.sort_rank(got)) == [1, 3, 6, 5]
    assert [r.is_top_pick for r in views.sort_rank(got).orderBy("pos").collect()] == [True, False, False, False]
    assert order(views.sort_price_asc(got)) == [5, 3, 1, 6]
    assert order(views.sort_price_desc(got)) == [6, 1, 3, 5]
    assert order(views.sort_rating_desc(got)) == [1, 3, 5, 6]
    card = {r.id: r for r in views.cards(got).collect()}[1]
    assert (card.cuisines, card.price, card.rating) == (["Cafe", "North Indian"], "₹700 for two", "4.9")


def test_views_with_missing_values(spark):
    df = spark.createDataFrame(
        [(1, "x", [(1, 1, 10, None, None, ["a"]), (2, 2, 11, 0.0, 3.0, []), (3, 3, 12, 5.0, 2.0, ["a", "b", "X", "x", "c"])])],
        "request_id bigint, cuisine string, items array<struct<rank int, rec_pos int, id bigint, cost_for_two double, rating double, cuisines array<string>>>")
    order = lambda view: [r.id for r in view(df).orderBy("pos").collect()]
    assert order(views.sort_price_asc) == [12, 10, 11]
    assert order(views.sort_price_desc) == [12, 10, 11]
    assert order(views.sort_rating_desc) == [11, 12, 10]
    cards = {r.id: r for r in views.cards(df).collect()}
    assert (cards[10].price, cards[10].rating, cards[10].cuisines) == ("Price N/A", None, ["a"])
    assert cards[12].cuisines == ["X", "a", "b"] and cards[11].cuisines == []


def test_scorer_runs_over_prompts(spark):
    catalog = spark.createDataFrame(CATALOG_ROWS, CATALOG)
    asked = spark.createDataFrame([(1, "btm", "cafe", 0.0, "medium"), (2, "nowhere", "cafe", 0.0, "low"), (3, "mg", "cafe", 4.0, "medium")], samples.REQUEST_SCHEMA)

    def scorer(batches):
        import json as j
        for batch in batches:
            out = batch[["request_id"]].copy()
            rows = [j.loads(p.split("Candidates (JSON)\n")[1].split("\n")[0]) for p in batch["prompt"]]
            out["attempt"] = 0
            out["raw"] = [j.dumps({"summary": "1 match", "recommendations": [{"restaurant_id": r[-1]["id"], "rank": 1, "explanation": "last"}]}) for r in rows]
            out["error"] = None
            yield out

    got = {r.request_id: (r.kind, [i.id for i in r["items"]]) for r in recommend.recommend(asked, catalog, scorer).collect()}
    assert got == {1: ("scored", [8]), 2: ("empty", []), 3: ("scored", [9])}
    plain = {r.request_id: r.kind for r in recommend.recommend(asked, catalog).collect()}
    assert plain == {1: "unavailable", 2: "empty", 3: "unavailable"}


def test_prompt_lists_whole_rows(spark):
    cells = shortlist.best_cells(spark.createDataFrame([(1, "A/é", "Btm", ["Cafe"], 4.0, None, "medium")], CATALOG))
    asked = spark.createDataFrame([(1, "Btm", "Cafe", 3.0, "medium")], samples.REQUEST_SCHEMA)
    text = scoring.prompts(shortlist.with_shortlist(asked, cells)).first().prompt
    rows = json.loads(text.split("Candidates (JSON)\n")[1].split("\n")[0])
    assert rows == [{"id": 1, "name": "A/é", "location": "Btm", "cuisines": ["Cafe"], "rating": 4.0, "cost_for_two": None, "budget": "medium"}]


# Worked out by hand from the patterns: what a text becomes for a number of items.
PATCHED = [
    ("Here are the top 5 recommendations", 0, "Here are the top 5 recommendations"),
    ("Here are the top 5 recommendations", 1, "Here are the one recommendation"),
    ("Here are the top 5 recommendations", 2, "Here are the top two recommendations"),
    ("Top five matches and 3 great recommendations", 1, "one recommendation"),
    ("Top five matches and 3 great recommendations", 3, "top three matches and 3 great recommendations"),
    ("two matches", 1, "one match"),
    ("two matches", 3, "three matches"),
    ("two matches", 7, "7 matches"),
    ("someone loves our recommendations", 1, "someone loves our recommendations"),
    ("someone loves our recommendations", 2, "sometwo loves our recommendations"),
    ("TOP 12 picks", 1, "top one picks"),
    ("TOP 12 picks", 5, "top five picks"),
    ("no numbers", 3, "no numbers"),
    ("4\nrecommendations", 1, "one recommendation"),
    ("4\nrecommendations", 2, "two\nrecommendations"),
    ("top  one recommendation; top two match", 1, "top one recommendation; top one match"),
    ("top  one recommendation; top two match", 2, "top two recommendation; top two match"),
    ("5 things\nthen recommendations", 1, "5 things\nthen recommendations"),
    ("5 things\nthen recommendations", 5, "5 things\nthen recommendations"),
    ("one Match", 2, "one Match"),
]


def test_patch_summary(spark):
    df = spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(PATCHED)], "i int, t string, n int")
    got = [r[0] for r in df.orderBy("i").select(messages.patch_summary(F.col("t"), F.col("n"))).collect()]
    assert got == [want for _, _, want in PATCHED]


def test_text_options(spark):
    df = spark.createDataFrame([("AI: 4.05 of 5.0", "someone loves 3 recommendations", 2)], "e string, s string, n int")
    row = df.select(
        messages.clean_explanation(F.col("e")), messages.clean_explanation(F.col("e"), strict_numbers=True),
        messages.patch_summary(F.col("s"), F.col("n")), messages.patch_summary(F.col("s"), F.col("n"), word_boundary=True)).first()
    assert tuple(row) == ("45 of 5", "4.05 of 5", "sometwo loves 3 recommendations", "someone loves two recommendations")


def test_a_scorer_gets_few_prompts_at_once(spark):
    rows = [(i, "btm", "cafe", 0.0, "low", [(1, i)]) for i in range(600)]
    asked = spark.createDataFrame(rows, "request_id long, location string, cuisine string, min_rating double, budget string, shortlist array<struct<pos int, id long>>").coalesce(1)

    def scorer(batches):
        for prompts in batches:
            yield prompts[["request_id"]].assign(attempt=len(prompts), raw="[]", error=None)

    got = scoring.score(asked, scorer).collect()
    assert sorted(r.request_id for r in got) == list(range(600)) and max(r.attempt for r in got) <= 256
