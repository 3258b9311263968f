"""The given tables seen as listings, requests and scorer responses.

The SELECTs are shared by Spark and the DuckDB oracle; only table names are filled in.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listforge.operators.numbering import number_rows
from listforge.plans import recommend, requests, shortlist
from listforge.plans.ingest import clean_catalog
from listforge.sources import read_raw
from listforge.sources.shared import keep

_LISTING = """
select {key} as src_key, concat('  ', p_name, ' ') as name,
 case when {key} % 97 = 0 then null else concat(' ', replace(lower(n_name), '_', '  ')) end as location,
 case when {key} % 11 = 0 then null when {key} % 13 = 0 then ' ' else concat(p_type, ',, ', p_brand, ' ') end as cuisines,
 case when {key} % 10 = 0 then 'NEW' when {key} % 10 = 1 then '-' when {key} % 10 = 2 then null when {key} % 10 = 3 then '7.5/5'
   else concat(cast(cast(floor(p_size / 10) as int) as varchar(9)), '.', cast(p_size % 10 as varchar(9)),
     case when {key} % 2 = 0 then ' /5' else '/5' end) end as rate,
 case when {key} % 13 = 5 then null when {key} % 13 = 6 then 'n/a'
   when ({key} * 37) % 2400 >= 1000 then concat('₹', cast(cast(floor((({key} * 37) % 2400) / 1000) as int) as varchar(9)), ',',
     lpad(cast((({key} * 37) % 2400) % 1000 as varchar(9)), 3, '0'))
   else concat('₹', cast(({key} * 37) % 2400 as varchar(9))) end as cost
"""
PART_LISTINGS = _LISTING.format(key="p_partkey") + " from {part} join {nation} on p_partkey % 25 = n_nationkey"
LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
LINEITEM_LISTINGS = _LISTING.format(key="src_key") + (
    " from {numbered} join {part} on l_partkey = p_partkey join {nation} on p_partkey % 25 = n_nationkey")

REQUESTS = """
select event_id as request_id, ts as requested_at,
 case when event_id % 41 = 0 then '  ' else concat(' nation ', cast(user_id % 25 as varchar(9))) end as location,
 case event_id % 3 when 0 then 'ECON' when 1 then 'promo' else 'brand#1' end as cuisine,
 case when event_id % 43 = 0 then 'abc' when event_id % 47 = 0 then '5.5' when event_id % 7 = 0 then null
   else cast(cast(floor(value / 100) as int) as varchar(9)) end as min_rating,
 case when event_id % 53 = 0 then 'super_cheap' when event_id % 3 = 0 then 'low' when event_id % 3 = 1 then 'medium' else 'high' end as budget
from {events}
"""

# Test texts of the scorer responses.
SAID = "Here are the top 6 recommendations for you, six of 40 matches."
PLAIN = "Sorry, here is some text instead."
WRONG = '{"summary": 6, "recommendations": []}'


class Tables:
    """Derived tables of one scale directory; each kept stage is written once per session."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def given(self, name: str) -> DataFrame:
        return read_raw(self.spark, f"{self.dir}/{name}.parquet")

    def raw_listings(self) -> DataFrame:
        return self.spark.sql(PART_LISTINGS, part=self.given("part"), nation=self.given("nation"))

    def raw_lineitem_listings(self) -> DataFrame:
        numbered = number_rows(self.given("lineitem").select(*LINEITEM_ORDER), *LINEITEM_ORDER, name="src_key")
        return self.spark.sql(LINEITEM_LISTINGS, numbered=numbered.select("src_key", "l_partkey"),
                              part=self.given("part"), nation=self.given("nation"))

    def raw_requests(self) -> DataFrame:
        return self.spark.sql(REQUESTS, events=self.given("events"))

    @cached_property
    def catalog(self) -> DataFrame:
        return keep(clean_catalog(self.raw_listings(), ["src_key"]), "catalog")

    @cached_property
    def requests(self) -> DataFrame:
        return keep(requests.requests_valid(self.raw_requests()), "requests")

    @cached_property
    def cells(self) -> shortlist.Cells:
        return shortlist.kept_cells(self.catalog)

    @cached_property
    def lists(self) -> DataFrame:
        return keep(shortlist.wish_lists(shortlist.wishes(self.requests), self.cells), "lists")

    @cached_property
    def shortlisted(self) -> DataFrame:
        """Not written: forty listings per request are far more than the requests and the lists they come from."""
        return shortlist.with_shortlist(self.requests, self.cells, lists=self.lists)

    @cached_property
    def responses(self) -> DataFrame:
        return keep(canned_responses(self.shortlisted), "responses")

    @cached_property
    def answered(self) -> DataFrame:
        return keep(recommend.answers(self.requests, self.cells, self.responses, lists=self.lists), "answered")


def canned_responses(shortlisted: DataFrame) -> DataFrame:
    """Responses of every kind, by ``request_id % 8``; each good one starts with an unknown id.

    0 good; 1 text, good; 2 wrong shape, good; 3 text three times; 4 error, good; 5 unknown ids only; 6 a
    list, good; 7 no response.
    """
    entry = lambda i, rank, text: F.struct(
        i.alias("restaurant_id"), rank.alias("rank"), text.alias("explanation"))
    unknown = entry(F.lit(-1).cast("bigint"), F.lit(9), F.lit("AI: unknown"))
    told = lambda x: F.concat(F.lit("AI: rated "), x["rating"].cast("string"), F.lit(" for "), x["cost_for_two"].cast("string"))
    ranked = F.transform(F.reverse(F.slice("shortlist", 1, 6)), lambda x: entry(x["id"], x["pos"], told(x)))
    body = lambda recs: F.to_json(F.struct(F.lit(SAID).alias("summary"), recs.alias("recommendations")))
    built = shortlisted.select(
        "request_id", body(F.concat(F.array(unknown), ranked)).alias("good"), body(F.array(unknown)).alias("lost"))

    none = F.lit(None).cast("string")
    row = lambda n, raw, error=none: F.struct(F.lit(n).alias("attempt"), raw.alias("raw"), error.alias("error"))
    good, plain = F.col("good"), F.lit(PLAIN)
    cases = {
        0: [row(0, good)],
        1: [row(0, plain), row(1, good)],
        2: [row(0, F.lit(WRONG)), row(1, good)],
        3: [row(0, plain), row(1, plain), row(2, plain)],
        4: [row(0, none, F.lit("timeout")), row(1, good)],
        5: [row(0, F.col("lost"))],
        6: [row(0, F.concat(F.lit("["), good, F.lit("]"))), row(1, good)],
    }
    chosen = None
    for n, rows in cases.items():
        hit = F.col("request_id") % 8 == n
        chosen = F.when(hit, F.array(*rows)) if chosen is None else chosen.when(hit, F.array(*rows))
    return built.select("request_id", F.inline(chosen))


_open: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        _open[key] = Tables(spark, sf_dir)
    return _open[key]
