"""Small catalogs and a plain-Python statement of the filter semantics to compare with."""

import random

from listforge.sources.schema import CATALOG

PLACES = ["Btm", "Btm Layout", "Indiranagar", "Koramangala 5Th Block", "100% Road", "A_B Street", None]
DISHES = ["North Indian", "South Indian", "Chinese", "Cafe", "Fast Food", "Biryani"]


def tier(cost):
    if cost is None:
        return None
    return "low" if cost < 500 else "medium" if cost <= 1500 else "high"


def catalog_rows(n=300, seed=1, hot=0.4):
    """``hot`` is the share of rows that sit in one single cell."""
    rng = random.Random(seed)
    rows = []
    for i in range(1, n + 1):
        if rng.random() < hot:
            place, dishes, cost = "Btm", ["North Indian"], 700.0
        else:
            place = rng.choice(PLACES)
            dishes = rng.sample(DISHES, rng.randint(0, 4))
            cost = rng.choice([None, 120.0, 499.99, 500.0, 900.0, 1500.0, 1500.5, 4000.0])
        rating = rng.choice([None, 0.0, 2.5, 3.1, 3.9, 4.0, 4.4, 4.9, 5.0])
        rows.append((i, f" Name {rng.randint(1, 40)}", place, dishes, rating, cost, tier(cost)))
    return rows


def catalog(spark, **kwargs):
    return spark.createDataFrame(catalog_rows(**kwargs), CATALOG)


def matches(row, location, cuisine):
    _, _, place, dishes, *_ = row
    return location.lower() in (place or "").lower(), any(cuisine.lower() in d.lower() for d in dishes)


def brute_shortlist(rows, location, cuisine, min_rating, budget, k=40):
    hits = [r for r in rows if all(matches(r, location, cuisine))
            and r[4] is not None and r[4] >= min_rating and r[6] == budget]
    return [r[0] for r in sorted(hits, key=lambda r: (-r[4], r[0]))[:k]]


def request_rows(n=120, seed=2, hot=0.4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rng.random() < hot:
            rows.append((i, "btm", "indian", rng.choice([0.0, 3.0, 4.5]), "medium"))
        else:
            rows.append((i, rng.choice(["BTM", "nagar", "0% r", "a_b", "a", "Nowhere", "block", "a%b"]),
                         rng.choice(["Indian", "CAFE", "food", "i", "Alien", "an"]),
                         rng.choice([0.0, 3.0, 3.95, 4.4, 5.0]), rng.choice(["low", "medium", "high"])))
    return rows


REQUEST_SCHEMA = "request_id bigint, location string, cuisine string, min_rating double, budget string"


def requests(spark, **kwargs):
    return spark.createDataFrame(request_rows(**kwargs), REQUEST_SCHEMA)
