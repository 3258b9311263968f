"""Times the headline queries; prints one JSON line.

Each time covers building the result from its inputs and running it to the end (noop sink).
``ingest_*`` start at the given tables, the rest at the kept catalog, request and response tables.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from checks.tables import Tables
from listforge.plans import funnel, ingest, options, quality, recommend, requests, shortlist, views
from listforge.sources.shared import keep


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        # No Python call sites on expressions: building the larger plans takes half the time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # The tables are small: without this AQE would merge them into fewer partitions than cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    t = Tables(spark, sf_dir)
    times = {}

    def run(name, build):
        start = time.time()
        build().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)

    t.given("nation").count()  # starts the JVM side
    large_raw = keep(t.raw_lineitem_listings())

    run("ingest_part", lambda: ingest.clean_catalog(t.raw_listings(), ["src_key"]))
    run("ingest_lineitem", lambda: ingest.clean_catalog(large_raw, ["src_key"]))
    run("ingest_lineitem_scan_order", lambda: ingest.clean_catalog(large_raw))
    large = keep(ingest.clean_catalog(large_raw, ["src_key"]))
    small = t.catalog

    run("quality_report", lambda: quality.quality_report(large))
    run("rating_summary", lambda: quality.rating_summary(large))
    run("options_locations", lambda: options.options_locations(large))
    run("options_cuisines", lambda: options.options_cuisines(large))
    run("requests_valid", lambda: requests.requests_valid(t.raw_requests()))
    # One small file would be one task; a large table comes in many.
    spread = lambda df: keep(df.repartition(int(cpus)))
    asked = spread(t.requests)
    wish = dict(location="nation 1", cuisine="econ", min_rating=2.0, budget="medium")
    run("shortlist_one", lambda: shortlist.shortlist_one(large, **wish))
    run("filter_funnel", lambda: funnel.filter_funnel(large, **wish))
    run("shortlist_batch", lambda: shortlist.shortlist_batch(asked, small))
    run("shortlist_batch_lineitem", lambda: shortlist.shortlist_batch(asked, large))
    run("filter_funnel_batch", lambda: funnel.filter_funnel_batch(asked, small))
    run("filter_funnel_batch_lineitem", lambda: funnel.filter_funnel_batch(asked, large))
    cells, responses = t.cells, spread(t.responses)
    run("recommend_payload", lambda: recommend.recommend_payload(recommend.answers(asked, cells, responses)))
    answered = t.answered
    run("recommend_items", lambda: recommend.recommend_items(answered))
    run("sort_price_asc", lambda: views.sort_price_asc(answered))
    run("display_labels", lambda: views.cards(answered))
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
