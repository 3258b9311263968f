"""Every operator as a query over the given tables. Arrays leave as text joined by ``|``."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listforge.functions import messages, numbers, text
from listforge.operators import predicates
from listforge.plans import delta, facts, funnel, identity, ingest, options, quality, recommend, requests, rounds, scoring, shortlist, views
from listforge.sources import read_catalog, read_raw, write_catalog
from listforge.sources.catalog import catalog_path
from listforge.sources.shared import keep, shared_dir, size_in

from .tables import PLAIN, WRONG, Tables, tables

WISH = dict(location="nation 1", cuisine="econ", min_rating=2.0, budget="medium")
NO_WISH = dict(location="no such place", cuisine="econ", min_rating=2.0, budget="medium")

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    _queries[f.__name__] = lambda spark, sf_dir: f(tables(spark, sf_dir))
    return f


def all_queries():
    return dict(_queries)


def _flat(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, "|") for c in columns})


# Ingest

@query
def raw_listings(t: Tables):
    return t.raw_listings()


@query
def clean_catalog(t: Tables):
    return _flat(ingest.clean_catalog(t.raw_listings(), ["src_key"]), "cuisines")


@query
def clean_catalog_lineitem(t: Tables):
    return _flat(ingest.clean_catalog(t.raw_lineitem_listings(), ["src_key"]), "cuisines")


@query
def clean_catalog_aliases(t: Tables):
    renamed = t.raw_listings().withColumnsRenamed({
        "name": "restaurant_name", "location": "City", "cuisines": "Cuisine",
        "rate": "aggregate_rating", "cost": "approx_cost(for two people)"})
    return _flat(ingest.clean_catalog(renamed, ["src_key"]), "cuisines")


@query
def clean_catalog_defaults(t: Tables):
    return _flat(ingest.clean_catalog(t.raw_listings().drop("name", "rate", "cost"), ["src_key"]), "cuisines")


@query
def clean_catalog_input_order(t: Tables):
    """Ids by file position, and numeric source columns."""
    raw = read_raw(t.spark, f"{t.dir}/part.parquet", positions=True).withColumnsRenamed({
        "p_name": "name", "p_brand": "area", "p_type": "cuisine", "p_size": "rating", "p_retailprice": "avg_cost"})
    return _flat(ingest.clean_catalog(raw), "cuisines")


@query
def catalog_roundtrip(t: Tables):
    path = f"{shared_dir(t.spark)}/listforge/roundtrip-{uuid.uuid4().hex}"
    write_catalog(ingest.clean_catalog(t.raw_listings(), ["src_key"]), path, partition_by_budget=True)
    return read_catalog(t.spark, path).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"),
        F.sum("cost_for_two").alias("sum_cost"))


@query
def clean_catalog_input_order_filtered(t: Tables):
    """Ids by file position where rows are missing: no gaps and no repeats."""
    raw = read_raw(t.spark, f"{t.dir}/part.parquet", positions=True).filter("p_size % 3 <> 1").withColumnsRenamed({
        "p_name": "name", "p_brand": "area", "p_type": "cuisine", "p_size": "rating", "p_retailprice": "avg_cost"})
    return _flat(ingest.clean_catalog(raw), "cuisines")


def range_bytes(size: int) -> int:
    """16 KB, or what cuts a larger file into 256 ranges."""
    return max(16 << 10, -(-size // 256))


@query
def clean_catalog_csv_order(t: Tables):
    """Ids by the order of a CSV file whose cells hold quotes, commas and line breaks, read in many byte ranges."""
    path = f"{shared_dir(t.spark)}/listforge/csv-{uuid.uuid4().hex}"
    said = F.concat(F.col("name"), F.lit(',\n"'), F.col("src_key").cast("string"), F.lit('"\n\n'))
    rows = t.raw_listings().select("src_key", F.when(F.col("src_key") % 3 == 0, said).otherwise(F.col("name")).alias("name"), "location", "cuisines", "rate", "cost")
    rows.coalesce(1).sortWithinPartitions("src_key").write.options(header=True, escape='"').csv(path)
    # Ranges far smaller than the file; a cluster's default would need a file of some hundred megabytes. Their number stays bounded.
    before = t.spark.conf.get("spark.sql.files.maxPartitionBytes")
    t.spark.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes(size_in(t.spark, path))))
    try:
        return _flat(ingest.clean_catalog(read_raw(t.spark, path, "csv", positions=True)), "cuisines")
    finally:
        t.spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@query
def ingest_published(t: Tables):
    """Rows and ids of the catalog that an ingest over an older version publishes, and the rules that fail."""
    path = f"{shared_dir(t.spark)}/listforge/published-{uuid.uuid4().hex}"
    write_catalog(t.catalog.filter("id <= 7"), path)
    done = ingest.ingest(t.raw_listings(), path, ["src_key"])
    failed = ",".join(sorted(r.rule for r in done.report if r.failed))
    return read_catalog(t.spark, path).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"),
        F.count_distinct("id").alias("n_ids")).withColumn("failed", F.lit(failed))


def _with_nan(t: Tables) -> DataFrame:
    """The catalog as a foreign system might hand it over: NaN for some missing numbers."""
    some = lambda c, n: F.when((F.col("id") % n == 0) & F.col(c).isNull(), float("nan")).otherwise(F.col(c)).alias(c)
    return t.catalog.select("id", "name", "location", "cuisines", some("rating", 2), some("cost_for_two", 1), "budget")


@query
def null_rates_nan(t: Tables):
    return quality.null_rates(_with_nan(t))


@query
def quality_report_nan(t: Tables):
    return quality.quality_report(_with_nan(t))


@query
def catalog_columns(t: Tables):
    path = f"{shared_dir(t.spark)}/listforge/columns-{uuid.uuid4().hex}"
    write_catalog(t.catalog, path)
    return quality.verification(t.spark, path)["columns"]


@query
def catalog_size(t: Tables):
    """Files of the newest version alone, and whether their size is known."""
    path = f"{shared_dir(t.spark)}/listforge/sized-{uuid.uuid4().hex}"
    write_catalog(t.catalog.filter("id <= 3"), path)
    write_catalog(t.catalog.coalesce(1), path, partition_by_budget=True)
    return quality.verification(t.spark, path)["size"].select("n_files", (F.col("size_kb") > 0).alias("sized"))


@query
def round_hundredths(t: Tables):
    """Tenths of numbers with two decimals, ties included."""
    hundredths = (F.col("p_partkey") % 501 / 100).alias("raw_value")
    return t.given("part").select(F.col("p_partkey").alias("id"), hundredths).withColumn("cleaned", numbers.one_decimal(F.col("raw_value")))


def _per_cell(name, column, function):
    def run(t: Tables):
        out = function(F.col(column))
        return t.raw_listings().select((F.col("src_key") + 1).alias("id"), F.col(column).alias("raw_value"),
                                       out.alias("cleaned"))
    run.__name__ = name
    query(run)


_per_cell("clean_rating", "rate", numbers.clean_rating)
_per_cell("clean_cost", "cost", numbers.clean_cost)
_per_cell("clean_cuisines", "cuisines", lambda c: F.array_join(text.split_cuisines(c), "|"))
_per_cell("normalize_location", "location", text.normalize_location)


@query
def assign_budget(t: Tables):
    return t.catalog.select("id", F.col("cost_for_two").alias("raw_value"),
                            numbers.assign_budget(F.col("cost_for_two")).alias("cleaned"))


# Quality

@query
def quality_report(t: Tables):
    return quality.quality_report(t.catalog)


@query
def duplicate_ids_dense(t: Tables):
    """Ids whose count, range and sums are those of 1..n although some stand twice; counted both ways and by both kinds of report."""
    wrong = F.element_at(F.array(*[F.lit(x) for x in (1, 3, 4, 5, 8, 9, 3, 4, 8)]), ((F.col("id") - 1) % 9 + 1).cast("int"))
    n = t.catalog.count() // 9 * 9
    ids = t.catalog.filter(F.col("id") <= n).withColumn("id", wrong + F.floor((F.col("id") - 1) / 9) * 9)
    ways = {"bits": quality.surplus_ids(ids, dense=True), "ids": quality.surplus_ids(ids, dense=False)}
    for way, numbered in (("numbered", True), ("foreign", False)):
        ways[way] = quality.quality_report(ids, numbered=numbered).filter("rule = 'duplicate_ids' and failed").select(F.col("value").cast("bigint").alias("n"))
    rows = [df.select(F.lit(way).alias("way"), "n") for way, df in ways.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query
def null_rates(t: Tables):
    return quality.null_rates(t.catalog)


@query
def budget_counts(t: Tables):
    return quality.budget_counts(t.catalog)


@query
def budget_counts_with_null(t: Tables):
    return quality.budget_counts(t.catalog, with_null=True)


@query
def rating_summary(t: Tables):
    return quality.rating_summary(t.catalog)


@query
def top_locations(t: Tables):
    return quality.top_locations(t.catalog)


@query
def catalog_preview(t: Tables):
    return _flat(quality.catalog_preview(t.catalog), "cuisines")


# Options

@query
def options_locations(t: Tables):
    return options.options_locations(t.catalog)


@query
def options_cuisines(t: Tables):
    return options.options_cuisines(t.catalog)


@query
def options_payload(t: Tables):
    return _flat(options.options_payload(t.catalog), "options")


# Filters and shortlists

@query
def filter_location(t: Tables):
    return t.catalog.filter(predicates.location_matches("nation 1")).select("id", "location")


@query
def filter_cuisine(t: Tables):
    return _flat(t.catalog.filter(predicates.cuisine_matches("ECON")).select("id", "cuisines"), "cuisines")


@query
def filter_rating(t: Tables):
    return t.catalog.filter(predicates.rating_at_least(0.0)).select("id", "rating")


@query
def filter_budget(t: Tables):
    return t.catalog.filter(predicates.budget_is("medium")).select("id", "budget")


@query
def filter_funnel(t: Tables):
    return funnel.filter_funnel(t.catalog, **WISH)


@query
def filter_funnel_batch(t: Tables):
    return funnel.filter_funnel_batch(t.requests, t.catalog)


@query
def shortlist_one(t: Tables):
    return shortlist.shortlist_one(t.catalog, **WISH).select("pos", "id", "name", "rating", "budget")


def _published(t: Tables, label: str) -> str:
    """Path of the catalog published in files that are ranges of places."""
    path = f"{shared_dir(t.spark)}/listforge/{label}-{uuid.uuid4().hex}"
    write_catalog(t.catalog.repartitionByRange(8, "location", "id"), path)
    return path


@query
def shortlist_published(t: Tables):
    """As shortlist_one, over the files that can hold the texts."""
    return shortlist.shortlist_published(t.spark, _published(t, "skipped"), **WISH).select("pos", "id", "name", "rating", "budget")


@query
def filter_location_published(t: Tables):
    found = read_catalog(t.spark, _published(t, "skipped"), location="nation 1")
    return found.filter(predicates.location_matches("nation 1")).select("id", "location")


@query
def quality_from_facts(t: Tables):
    """Rules from the facts of a catalog that grew by an append, of which the second report read the new files alone."""
    path = _published(t, "facts")
    facts.facts(t.spark, path)
    t.catalog.filter("id % 3 = 0").coalesce(1).write.mode("append").parquet(catalog_path(t.spark, path))
    return facts.report_from_facts(facts.facts(t.spark, path))


@query
def rating_summary_from_facts(t: Tables):
    return facts.rating_summary_from_facts(facts.facts(t.spark, _published(t, "facts")))


@query
def shortlist_empty(t: Tables):
    return shortlist.shortlist_one(t.catalog, **NO_WISH).select("pos", "id", "name", "rating", "budget")


@query
def shortlist_batch(t: Tables):
    return shortlist.shortlist_batch(t.requests, t.catalog).select("request_id", "pos", "id", "name", "rating")


# Requests

@query
def requests_valid(t: Tables):
    return requests.requests_valid(t.raw_requests())


@query
def requests_rejected(t: Tables):
    return _flat(requests.requests_rejected(t.raw_requests()), "errors")


@query
def requests_summary(t: Tables):
    return requests.requests_summary(requests.requests_valid(t.raw_requests()))


@query
def requests_json(t: Tables):
    """Requests as JSON texts with a threshold that is absent, null, a number, a text, a list, no number or too large."""
    given = F.element_at(F.array(*[F.lit(x) for x in ("", ', "min_rating": null', ', "min_rating": 3.5', ', "min_rating": "4"', ', "min_rating": [3]', ', "min_rating": "abc"', ', "min_rating": 6')]),
                         (F.col("request_id") % 7 + 1).cast("int"))
    body = F.concat(F.lit('{"location": "'), "location", F.lit('", "cuisine": "'), "cuisine", F.lit('", "budget": "'), "budget", F.lit('"'), given, F.lit("}"))
    found = requests.checked(requests.from_json(t.raw_requests().select("request_id", body.alias("body"))))
    return _flat(found.select("request_id", "location", "min_rating", "errors"), "errors")


@query
def outer_errors(t: Tables):
    """Fallbacks of requests whose scorer failed outside its attempts, inside them, or was not there."""
    way = F.col("request_id") % 3
    failed = t.requests.filter(way < 2).select("request_id", F.when(way == 1, 0).cast("int").alias("attempt"), F.lit(None).cast("string").alias("raw"), F.lit("boom").alias("error"))
    return recommend.answers(t.requests, t.cells, failed).select("request_id", "kind", F.size("recs").alias("n_recs"))


# Scoring and answers

@query
def prompt_payload(t: Tables):
    return scoring.prompts(t.shortlisted)


@query
def responses_fixture(t: Tables):
    return t.responses


@query
def parse_responses(t: Tables):
    return scoring.judged(t.responses).select("request_id", "attempt", "status")


@query
def first_valid_attempt(t: Tables):
    return scoring.first_valid_attempt(t.responses)


@query
def valid_recs(t: Tables):
    return recommend.valid_recs(t.answered)


@query
def hallucinated_recs(t: Tables):
    return recommend.hallucinated_recs(t.answered)


@query
def fallback_recs(t: Tables):
    return recommend.fallback_recs(t.answered)


@query
def recommend_items(t: Tables):
    return _flat(recommend.recommend_items(t.answered), "cuisines")


@query
def clean_explanation(t: Tables):
    said = F.concat(F.lit("AI: "), "name", F.lit(" has 4.05 of 5.00, cost "), F.coalesce(F.col("cost_for_two").cast("string"), F.lit("AI:?")))
    return t.catalog.select("id", messages.clean_explanation(said).alias("explanation"))


@query
def summary_patch(t: Tables):
    said = F.concat(F.lit("Top "), (F.col("request_id") % 9).cast("string"),
                    F.lit(" picks: someone found FIVE great Recommendations and two matches, top three, one Match"))
    n = (F.col("request_id") % 7).cast("int")
    return t.requests.select("request_id", n.alias("n_items"), messages.patch_summary(said, n).alias("summary"))


@query
def recommend_summary(t: Tables):
    return recommend.recommend_summary(t.answered)


@query
def recommend_payload(t: Tables):
    return recommend.recommend_payload(t.answered).select(
        "request_id", "summary", F.to_json("items", {"ignoreNullFields": "false"}).alias("items"))


# Views

for _view in (views.sort_rank, views.sort_price_asc, views.sort_price_desc, views.sort_rating_desc):
    _queries[_view.__name__] = lambda spark, sf_dir, view=_view: view(tables(spark, sf_dir).answered)


def _gapped(t: Tables) -> DataFrame:
    """Answers of four listings each, whose price or rating may be missing or 0."""
    gone = lambda c, n, zero: F.when(F.col("id") % n == 0, None).when(F.col("id") % n == 1, 0.0).otherwise(F.col(c)).alias(c)
    item = F.struct(F.col("rank"), F.col("rank").cast("int").alias("rec_pos"), "id", "cuisines", gone("rating", 3, 0.0), gone("cost_for_two", 5, 0.0))
    rows = t.catalog.withColumn("rank", F.col("id") % 4 + 1).withColumn("request_id", F.floor(F.col("id") / 4))
    return rows.groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("cuisine", F.lit("ECON"))


for _view in (views.sort_price_asc, views.sort_price_desc, views.sort_rating_desc):
    _queries[f"{_view.__name__}_gaps"] = lambda spark, sf_dir, view=_view: view(_gapped(tables(spark, sf_dir)))


@query
def display_labels_gaps(t: Tables):
    return views.cards(_gapped(t)).select("request_id", "id", "price", "rating")


@query
def scored_by_hook(t: Tables):
    """Responses of a scorer that runs in the tasks: it counts the candidates and praises the first."""
    def scorer(batches):
        import json

        for prompts in batches:
            found = [json.loads(p.split("Candidates (JSON)\n")[1].split("\n")[0]) for p in prompts["prompt"]]
            yield prompts[["request_id"]].assign(attempt=0, error=None, raw=[json.dumps({
                "summary": f"{len(c)} candidates", "recommendations": [{"restaurant_id": c[0]["id"], "rank": 1, "explanation": c[0]["name"]}]}) for c in found])

    responses = scoring.score(t.shortlisted, scorer)
    best = scoring.outcomes(responses)
    return best.select("request_id", "attempt", "summary", F.inline("recommendations"))


def moody():
    """A scorer that needs one to three attempts or fails for good, by its first candidate's id; made here, so that it travels with its code."""
    plain, wrong = PLAIN, WRONG

    def call(prompt: str, attempt: int) -> str:
        import json

        first = json.loads(prompt.split("Candidates (JSON)\n")[1].split("\n")[0])[0]
        mood = first["id"] % 5
        if mood == 3 and attempt == 1:
            raise TimeoutError("no answer")
        if mood == 4 or attempt < min(mood, 2):
            return wrong if mood == 2 else plain
        return json.dumps({"summary": f"answer {attempt}", "recommendations": [{"restaurant_id": first["id"], "rank": 1, "explanation": first["name"]}]})
    return call


@query
def scored_in_rounds(t: Tables):
    """Every call that rounds of retries make, with what became of it."""
    ledger = f"{shared_dir(t.spark)}/listforge/ledger-{uuid.uuid4().hex}"
    called = rounds.score_in_rounds(t.requests, moody(), ledger, lists=t.lists)
    return scoring.judged(called, carry=("error",)).select("request_id", "attempt", "error", "status", F.get("recommendations", F.lit(0))["restaurant_id"].alias("restaurant_id"))


def _newer(t: Tables) -> DataFrame:
    """The catalog's next version: listings gone, re-rated, closed down to one cell, and new."""
    rated = F.when(F.col("id") % 11 == 0, F.col("rating") / 2).otherwise(F.col("rating"))
    left = t.catalog.filter((F.col("id") % 7 != 0) & ~((F.col("location") == "Nation 1") & (F.col("id") % 10 != 3))).withColumn("rating", rated)
    new = t.catalog.filter(F.col("id") % 13 == 0).withColumns({"id": F.col("id") + 1_000_000, "rating": F.least(F.col("rating") + 0.25, F.lit(5.0))})
    return left.unionByName(new)


@query
def shortlist_after_delta(t: Tables):
    """Shortlists from cells that were kept up with the next version's changes."""
    newer = _newer(t)
    removed, added = delta.changes(t.catalog, newer)
    state = delta.update_cells(keep(delta.cell_state(t.catalog, slack=10), "cell-state"), removed, added, newer, slack=10)
    return shortlist.shortlist_batch(t.requests, None, delta.cells_of(state)).select("request_id", "pos", "id", "rating")


@query
def ids_after_reingest(t: Tables):
    """Ids after rows went, changed and came: unchanged rows keep theirs, others continue after the last."""
    raw = t.raw_listings()
    _, id_map = identity.stable_ids(raw, t.spark.createDataFrame([], identity.ID_MAP), ["src_key"])
    changed = F.when(F.col("src_key") % 11 == 0, F.lit("4.9/5")).otherwise(F.col("rate"))
    other = raw.filter("src_key % 7 <> 0").withColumn("rate", changed)
    came = raw.filter("src_key % 13 = 0").withColumns({"src_key": F.col("src_key") + 1_000_000, "name": F.concat(F.lit("new "), "src_key")})
    catalog, following = identity.stable_ids(other.unionByName(came), id_map, ["src_key"])
    gone = identity.tombstones(following).select("id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("rating"), F.lit(True).alias("gone"))
    return catalog.select("id", "name", "rating", F.lit(False).alias("gone")).union(gone)


@query
def shortlist_batch_broad(t: Tables):
    """Requests whose one- and two-letter texts nearly every place and dish holds."""
    letters = lambda n: F.element_at(F.array(*[F.lit(x) for x in ("a", "n", "i", "o", "at", "on", "na", "ti")]), (n % 8 + 1).cast("int"))
    asked = t.requests.select("request_id", letters(F.col("request_id")).alias("location"),
                              letters(F.floor(F.col("request_id") / 8)).alias("cuisine"), "min_rating", "budget")
    return shortlist.shortlist_batch(asked, t.catalog, t.cells).select("request_id", "pos", "id", "rating")


@query
def display_cuisines(t: Tables):
    return _flat(views.cards(t.answered).select("request_id", "id", "cuisines"), "cuisines")


@query
def display_labels(t: Tables):
    return views.cards(t.answered).select("request_id", "id", "price", "rating")
