import contextlib
import json
import os
import signal
from collections import Counter

import pytest
from pyspark.sql import functions as F

from listforge.plans import recommend, rounds, scoring, shortlist

from tests.samples import REQUEST_SCHEMA, catalog

GOOD = '{"summary": "s", "recommendations": []}'


@pytest.fixture
def asked(spark):
    rows = [(i, "btm", "cafe", 0.0, "low", [(1, i, "a", 4.0)]) for i in range(60)] + [(99, "nowhere", "cafe", 0.0, "low", [])]
    return spark.createDataFrame(rows, "request_id long, location string, cuisine string, min_rating double, budget string, "
                                       "shortlist array<struct<pos int, id long, name string, rating double>>")


def noted(folder, behave):
    """A scorer that leaves one file per process with the calls it answered or broke off."""
    def call(prompt, attempt):
        i = json.loads(prompt.split("Candidates (JSON)\n")[1].split("\n")[0])[0]["id"]
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.write(f"{i} {attempt}\n")
        return behave(i, attempt)
    return call


def calls(folder):
    return Counter(tuple(map(int, line.split())) for name in os.listdir(folder) for line in open(f"{folder}/{name}"))


def test_only_failed_requests_are_called_again(spark, asked, tmp_path):
    def behave(i, attempt):
        if i % 4 == 3 and attempt == 1:
            raise ConnectionError("down")
        return GOOD if attempt >= i % 4 else "no json"

    (tmp_path / "calls").mkdir()
    ledger = str(tmp_path / "ledger")
    got = rounds.score_in_rounds(asked, noted(tmp_path / "calls", behave), ledger, calls=7, claims=25)
    made = calls(tmp_path / "calls")
    # 0 at once, 1 after one failure, 2 after two, 3 stops at the error of its second call.
    assert made == {(i, a): 1 for i in range(60) for a in range(i % 4 + 1 if i % 4 < 3 else 2)}
    assert sorted((r.request_id, r.attempt) for r in got.collect()) == sorted(made)
    ended = {r.request_id: r.attempt for r in scoring.outcomes(got).collect()}
    assert ended == {i: i % 4 if i % 4 < 3 else None for i in range(60)}
    # All done: another run calls nobody.
    rounds.score_in_rounds(asked, noted(tmp_path / "calls", behave), ledger)
    assert calls(tmp_path / "calls") == made


def test_a_killed_scorer_repeats_no_answered_call(spark, asked, tmp_path):
    (tmp_path / "calls").mkdir()
    fuse, ledger = tmp_path / "fuse", str(tmp_path / "ledger")
    fuse.write_text("")

    def behave(i, attempt):
        if i == 41 and fuse.exists():
            fuse.unlink()
            os.kill(os.getpid(), signal.SIGKILL)
        return "no json"

    with pytest.raises(Exception):
        rounds.score_in_rounds(asked, noted(tmp_path / "calls", behave), ledger, calls=3)
    before = calls(tmp_path / "calls")
    answered = {(r.request_id, r.attempt) for r in rounds.read_ledger(spark, ledger).filter("status <> 'claimed'").collect()}
    assert answered and answered < set(before)  # finished tasks are there, the killed one is not
    got = rounds.score_in_rounds(asked, noted(tmp_path / "calls", behave), ledger, calls=3)
    made = calls(tmp_path / "calls")
    assert all(made[c] == 1 for c in answered) and set(made.values()) == {1}
    assert max(Counter(i for i, _ in made).values()) <= 3
    per_request = Counter(r.request_id for r in got.collect())
    assert set(per_request) == set(range(60)) and max(per_request.values()) <= 3


def test_lost_claims_end_as_an_error(spark, asked, tmp_path):
    ledger = str(tmp_path / "ledger")
    claims = asked.filter("request_id = 5").crossJoin(spark.range(3).select(F.col("id").cast("int").alias("attempt")))
    claims.selectExpr("request_id", "attempt", "string(null) raw", "string(null) error", "'claimed' status").write.parquet(ledger)
    got = rounds.score_in_rounds(asked, lambda prompt, attempt: GOOD, ledger)
    assert {r.request_id: r.error for r in got.collect() if r.request_id == 5} == {5: "lost"} and got.count() == 60


def test_answers_that_are_no_text(spark, asked, tmp_path):
    got = rounds.score_in_rounds(asked.filter("request_id < 3"), lambda prompt, attempt: None, str(tmp_path / "ledger"))
    assert [(r.raw, r.error) for r in got.collect()] == [(None, "no text but NoneType")] * 3


def test_whole_answers(spark, tmp_path):
    cells = shortlist.best_cells(catalog(spark))
    requests = spark.createDataFrame([(1, "btm", "indian", 0.0, "medium"), (2, "nowhere", "cafe", 0.0, "low")], REQUEST_SCHEMA)

    def second_try(prompt, attempt):
        first = json.loads(prompt.split("Candidates (JSON)\n")[1].split("\n")[0])[0]
        return json.dumps({"summary": "one match", "recommendations": [{"restaurant_id": first["id"], "rank": 1, "explanation": "good"}]}) if attempt else "?"

    got = {r.request_id: r for r in recommend.recommend_in_rounds(requests, cells, second_try, str(tmp_path / "ledger")).collect()}
    assert got[1].kind == "scored" and got[1].n_items == 1 and got[2].kind == "empty"


@pytest.mark.parametrize("small", [1_000, 0])
def test_rounds_over_lists_keep_no_prompts(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(shortlist, "SMALL_LISTS", small)
    kept = []
    plain = rounds.keep
    monkeypatch.setattr(rounds, "keep", lambda df, label: kept.append(df.columns) or plain(df, label))
    asked = spark.createDataFrame([(i, "btm", "cafe", 0.0, "low") for i in (*range(12), 5)] + [(99, "nowhere", "cafe", 0.0, "low")], "request_id long, location string, cuisine string, min_rating double, budget string")
    found = [(1, 7, "a", 4.0)]
    lists = spark.createDataFrame([("btm", "cafe", "low", found), ("nowhere", "cafe", "low", [])], "place string, dish string, budget string, listings array<struct<pos int, id long, name string, rating double>>") \
        .withColumn("listings", shortlist.sized(F.col("listings"), "listings", 40))
    (tmp_path / "calls").mkdir()
    got = rounds.score_in_rounds(asked, noted(tmp_path / "calls", lambda i, attempt: GOOD if attempt else "no json"), str(tmp_path / "ledger"), calls=4, claims=7, lists=lists)
    assert sorted((r.request_id, r.attempt) for r in got.collect()) == [(i, a) for i in range(12) for a in (0, 1)]
    # A request that stands there twice is called for each row, as before.
    assert calls(tmp_path / "calls") == {(7, 0): 13, (7, 1): 13}
    assert kept and not any({"prompt", "shortlist"} & set(columns) for columns in kept)


@pytest.mark.parametrize("small", [1_000, 0])
def test_listings_are_written_out_once_per_list(spark, tmp_path, monkeypatch, small):
    """Prompts from the lists' texts equal whole ones, and nothing makes the JSON of a shortlist per call."""
    monkeypatch.setattr(shortlist, "SMALL_LISTS", small)
    rows = [(i, "Btm", "Café \"x\"", (0.0, 2.5, 4.0, 5.0)[i % 4], "low") for i in range(12)] + [(20, "hsr", "i", 1.0, "high"), (21, "nowhere", "i", 0.0, "low")]
    asked = spark.createDataFrame(rows, REQUEST_SCHEMA)
    listing = "array<struct<pos int, id long, name string, location string, cuisines array<string>, rating double, cost_for_two double, budget string>>"
    found = [(n, n, f'"{n}" é\n', None, ["a", None], 5.0 - n / 10, None if n % 2 else 1e7, "low") for n in range(1, 51)]
    lists = spark.createDataFrame([("btm", 'café "x"', "low", found), ("hsr", "i", "high", found[:1]), ("nowhere", "i", "low", [])], f"place string, dish string, budget string, listings {listing}") \
        .withColumn("listings", shortlist.sized(F.col("listings"), "listings", 50))
    whole = {r.request_id: r.prompt for r in scoring.prompts(shortlist.with_shortlist(asked, None, lists=lists)).collect()}
    assert set(whole) == {i for i, _, _, least, _ in rows if least < 5.0 and i != 21}

    def every_call(*_):
        raise AssertionError("a shortlist is written out for a call")

    monkeypatch.setattr(rounds, "prompts", every_call)
    got = rounds.score_in_rounds(asked, lambda prompt, attempt: prompt, str(tmp_path / "ledger"), calls=2, claims=4, lists=lists)
    assert {(r.request_id, r.attempt): r.raw for r in got.collect()} == {(i, a): p for i, p in whole.items() for a in range(3)}


def test_a_wave_reads_its_own_rows(spark, asked, tmp_path, monkeypatch):
    kept = {}
    plain = rounds.keep
    monkeypatch.setattr(rounds, "keep", lambda df, label: kept.setdefault(label, plain(df, label)))
    monkeypatch.setattr(rounds, "kept_tables", lambda spark: contextlib.nullcontext())
    got = rounds.score_in_rounds(asked, lambda prompt, attempt: GOOD, str(tmp_path / "ledger"), max_retries=0, claims=7)
    assert got.count() == 60
    in_order = [r._wave for r in kept["waves"].collect()]
    assert in_order == sorted(in_order) and set(in_order) == set(range(9))
