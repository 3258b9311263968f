"""From requests, catalog and scorer responses to final answers.

One row per request carries its shortlist (at most 40 listings) and its recommendations as
arrays. Membership, lookup, clone removal, ranking and texts are array expressions on that row,
so nothing after the two joins is shuffled, whatever the number of requests.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.messages import clean_explanation, empty_summary, patch_summary, rating_explanation
from ..functions.numbers import one_decimal, whole_number
from ..functions.text import strip
from ..sources.schema import RESPONSE
from ..sources.shared import keep
from .rounds import Call, score_in_rounds
from .scoring import Scorer, outcomes, score
from .shortlist import Cells, indexed, kept_cells, wish_lists, wishes, with_shortlist


def _fallback(explanation) -> Column:
    """The first five of the shortlist, ranked by position."""
    return F.transform(
        F.slice("shortlist", 1, fixed.MAX_RECOMMENDATIONS),
        lambda x: F.struct(
            x["pos"].alias("rec_pos"), x["id"].alias("restaurant_id"), x["pos"].cast("bigint").alias("rank"),
            explanation(x).alias("explanation"),
        ),
    )


def answers(requests: DataFrame, cells: DataFrame | Cells, responses: DataFrame,
            max_retries: int = fixed.MAX_RETRIES, strict_numbers: bool = False,
            word_boundary: bool = False, lists: DataFrame | None = None) -> DataFrame:
    """Per valid request: ``kind``, proposals as answered, ``recs``, ``items`` and ``summary``.

    ``kind`` is ``scored`` or the fallback taken: ``empty`` (no candidates), ``error`` (failure outside the
    attempts), ``unavailable`` (no responses at all), ``failed`` (no attempt was valid).
    """
    outcome = outcomes(responses, max_retries).withColumnsRenamed({"summary": "said", "recommendations": "proposed"})
    joined = with_shortlist(requests, cells, extra=outcome.withColumn("seen", F.lit(True)), lists=lists)
    typed = joined.withColumns({
        "kind": F.when(F.size("shortlist") == 0, "empty")
        .when(F.col("outer_error"), "error")
        .when(F.col("seen").isNull(), "unavailable")
        .when(F.col("attempt").isNull(), "failed")
        .otherwise("scored"),
        "ids": F.transform("shortlist", lambda x: x["id"]),
    })
    proposals = typed.withColumn("proposals", F.transform(
        F.when(F.col("kind") == "scored", F.col("proposed")),
        lambda r, i: F.struct((i + 1).alias("rec_pos"), r["restaurant_id"].alias("restaurant_id"),
                              r["rank"].alias("rank"), r["explanation"].alias("explanation"),
                              F.array_contains("ids", r["restaurant_id"]).alias("known")),
    ))
    known = F.slice(
        F.transform(
            F.filter("proposals", lambda r: r["known"]), lambda r: r.dropFields("known")),
        1, fixed.MAX_RECOMMENDATIONS)
    chosen = proposals.withColumn(
        "recs",
        F.when(F.col("kind") == "scored", known)
        .when(F.col("kind") == "unavailable", _fallback(lambda x: F.lit(fixed.UNAVAILABLE_EXPLANATION)))
        .when(F.col("kind") == "failed", _fallback(lambda x: rating_explanation(x["rating"]))),
    )
    found = chosen.withColumn("found", F.transform("recs", lambda r: F.struct(
        r["rank"].alias("rank"), r["rec_pos"].alias("rec_pos"), r["explanation"].alias("explanation"),
        F.get("shortlist", F.array_position("ids", r["restaurant_id"]).cast("int") - 1).alias("listing"),
    )))
    named = found.withColumn("names", F.transform("found", lambda x: F.lower(strip(x["listing"]["name"]))))
    # First seen wins; one id has one name, so this removes repeated ids as well.
    firsts = named.withColumn("firsts", F.filter(
        "found", lambda x, i: F.array_position("names", F.get("names", i)) == i + 1))
    item = lambda x: F.struct(
        x["rank"].alias("rank"), x["rec_pos"].alias("rec_pos"), x["listing"]["id"].alias("id"),
        x["listing"]["name"].alias("name"), x["listing"]["cuisines"].alias("cuisines"),
        one_decimal(x["listing"]["rating"]).alias("rating"),
        whole_number(x["listing"]["cost_for_two"]).alias("cost_for_two"),
        clean_explanation(x["explanation"], strict_numbers).alias("explanation"),
    )
    items = firsts.withColumn("items", F.coalesce(F.array_sort(F.transform("firsts", item)), F.array()))
    counted = items.withColumn("n_items", F.size("items"))
    summary = (
        F.when(F.col("kind") == "empty", empty_summary(F.col("location")))
        .when(F.col("kind") == "error", fixed.ERROR_SUMMARY)
        .when(F.col("kind") == "unavailable", fixed.UNAVAILABLE_SUMMARY)
        .when(F.col("kind") == "failed", fixed.FAILED_SUMMARY)
        .otherwise(F.col("said"))
    )
    said = counted.withColumn("said", summary)
    return said.select(
        "request_id", "location", "cuisine", "min_rating", "budget", "kind", "proposals", "recs", "items", "n_items",
        patch_summary(F.col("said"), F.col("n_items"), word_boundary).alias("summary"),
    )


def recommend(requests: DataFrame, catalog: DataFrame | None, scorer: Scorer | None = None,
              cells: DataFrame | Cells | None = None, tasks: int | None = None) -> DataFrame:
    """The whole way for a table of valid requests; without a scorer the rating fallback answers.

    ``cells`` built before from the catalog take its place.
    """
    cells = kept_cells(catalog) if cells is None else indexed(cells)
    if scorer is None:
        return answers(requests, cells, requests.sparkSession.createDataFrame([], RESPONSE))
    # Two uses: the prompts and the answers. One row per distinct wish is far less than one per request.
    lists = keep(wish_lists(wishes(requests), cells), "lists")
    # Kept, since a scorer call is neither cheap nor repeatable.
    responses = keep(score(with_shortlist(requests, cells, lists=lists), scorer, tasks), "responses")
    return answers(requests, cells, responses, lists=lists)


def recommend_in_rounds(requests: DataFrame, cells: DataFrame | Cells, call: Call, ledger: str,
                        max_retries: int = fixed.MAX_RETRIES) -> DataFrame:
    """The whole way with a scorer that answers one prompt: rounds of calls, only failed requests called again.

    ``ledger`` is the path of the table of calls; the same path after a crash goes on from there.
    """
    lists = keep(wish_lists(wishes(requests), cells), "lists")
    responses = score_in_rounds(requests, call, ledger, max_retries, lists=lists)
    return answers(requests, cells, responses, max_retries, lists=lists)


def valid_recs(answered: DataFrame) -> DataFrame:
    """Known ids in response order, at most five; ``rec_pos`` is the place in the response."""
    return answered.filter(F.col("kind") == "scored").select("request_id", F.inline("recs")).drop("explanation")


def hallucinated_recs(answered: DataFrame) -> DataFrame:
    """Proposed ids that are not in the shortlist."""
    return (
        answered.filter(F.col("kind") == "scored").select("request_id", F.inline("proposals"))
        .filter(~F.col("known")).select("request_id", "rec_pos", "restaurant_id", "rank")
    )


def fallback_recs(answered: DataFrame) -> DataFrame:
    """Recommendations of requests without a usable response; kinds without any show one row of nulls."""
    return answered.filter(F.col("kind") != "scored").select("request_id", "kind", F.inline_outer("recs")).drop("rec_pos")


def recommend_items(answered: DataFrame) -> DataFrame:
    return answered.select("request_id", F.inline("items")).select(
        "request_id", "rec_pos", "rank", "id", "name", "cuisines", "rating", "cost_for_two", "explanation")


def recommend_summary(answered: DataFrame) -> DataFrame:
    return answered.select("request_id", "n_items", "summary")


def recommend_payload(answered: DataFrame) -> DataFrame:
    """One document per request; requests without recommendations have an empty item list."""
    shown = F.transform("items", lambda x: F.struct(
        x["name"].alias("name"), x["cuisines"].alias("cuisines"), x["rating"].alias("rating"),
        x["cost_for_two"].alias("cost_for_two"), x["explanation"].alias("explanation"), x["rank"].alias("rank")))
    return answered.select("request_id", "summary", shown.alias("items"))
