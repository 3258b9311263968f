"""Mixing against a worked target table and its laws; sharding against an exhaustive minimax."""

import itertools
import random
import zlib

import numpy as np
import pytest

from listforge.llm import mixing, sharding


def brute_targets(sizes):
    """Share, stop, and share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        shares = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        above = [s for s in rest if shares[s] > 2 * sizes[s]]
        if not above:
            return fixed | shares
        fixed |= {s: 2.0 * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10}, {"a": 5, "é": 50, "Z": 500, None: 5000}, {"a": 0, "b": 7}, {"only": 9}, {"a": 0}, {"b": 3, None: 0, "c": 3, "d": 3, "e": 90}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_split_tree():
    quotas = np.array([7, 0, 30, 11])
    dealt = mixing.split_tree(quotas, 6, np.random.default_rng(1))
    assert (dealt.sum(0) == quotas).all() and (dealt >= 0).all()
    assert dealt.sum(1).max() - dealt.sum(1).min() <= 1


@pytest.fixture(scope="module")
def sources(make):
    rng = random.Random(3)
    return make(*[(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)])


def test_mix(sources):
    rows, again = (sorted(mixing.mix(sources).collect()) for _ in range(2))
    assert rows == again
    sizes = {r.source: r.source_size for r in rows}
    want = brute_targets(sizes)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert sum(r["size"] for r in own) == sizes[s] and own[0].target == pytest.approx(want[s])
        assert abs(sum(r["size"] * len(r.draws) for r in own) - want[s]) <= 20
    assert max(len(r.draws) for r in rows) <= 2
    shard = np.bincount([d.shard for r in rows for d in r.draws for _ in range(r["size"])], minlength=mixing.SHARDS)
    assert shard.max() < 2 * shard.min()
    taken = mixing.mixture(sources, placed=True).collect()
    assert len(taken) == sum(len(r.draws) for r in rows)
    assert sources.columns + ["shard", "key"] == list(taken[0].asDict())


def test_mix_odd_rows(odd, clashing):
    for docs in (odd, clashing):
        rows = mixing.mix(docs).collect()
        assert len(rows) == odd.count()
        assert [r["size"] for r in rows if r.doc_id == 3] == [0]
        out = mixing.mixture(docs)
        assert out.columns == docs.columns
        assert out.count() == sum(len(r.draws) for r in rows)
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixture(odd.limit(0)).count() == 0


def test_mix_of_repeated_rows(make):
    """Rows of one document count each for themselves, so the target is met within half a document."""
    docs = make(*[(7, "ten words are in this text and that is it", "a")] * 300, *[(1000 + i, "w " * 30, "b") for i in range(50)], *[(2000 + i, "w " * 30, "c") for i in range(50)])
    rows = mixing.mix(docs).collect()
    for s in "abc":
        own = [r for r in rows if r.source == s]
        assert abs(sum(r["size"] * len(r.draws) for r in own) - own[0].target) <= own[0]["size"] / 2 + 1e-6
    out = mixing.mixture(docs, placed=True)
    assert out.count() == sum(len(r.draws) for r in rows)
    assert sorted((r.shard, r.key) for r in out.collect()) == sorted(tuple(d) for r in rows for d in r.draws)


def test_the_tree_decides_the_shards(sources, monkeypatch):
    monkeypatch.setattr(mixing, "split_tree", lambda quotas, shards, rng: np.stack([quotas, *[0 * quotas] * (shards - 1)]))
    big = [r for r in mixing.mix(sources).collect() if r.draws]
    assert {d.shard for r in big for d in r.draws} == {0}


def test_shards_draw_exact_quotas_of_disjoint_blocks(spark):
    rows = mixing._quota_table(spark, [(0, 37), (3, 2), (5, 200)], 8, 5).collect()
    dealt = []
    for r in rows:
        places = sorted((r["_factor"] * b + r["_summand"]) % r["_n"] for b in range(r["_n"]))
        assert places == list(range(r["_n"])) and r["_ends"][-1] == r["_n"]
        dealt.append(np.diff([0, *r["_ends"]]))
    sums = np.sum(dealt, 0)
    assert sums.sum() == 239 and sums.max() - sums.min() <= 1


def test_very_many_sources(make):
    docs = make(*[(i, "a b c", f"s{i:05d}") for i in range(3000)])
    rows = mixing.mix(docs).collect()
    want = brute_targets({f"s{i:05d}": 3 for i in range(3000)})
    assert {r.source: r.target for r in rows} == pytest.approx(want)
    assert len({d.shard for r in rows for d in r.draws}) == 8


def test_equal_rows_spread_over_ranges(spark, make, monkeypatch):
    from listforge.llm import common

    parts = []
    keep = common.keep
    monkeypatch.setattr(common, "keep", lambda df, label="stage": (parts.append(keep(df, label)), parts[-1])[1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = make(*[(1, "one text")] * 2000).repartition(4)
    rows = docs.selectExpr("1 as mark", "doc_id", "1 as one")
    got = common.ordered_totals(rows, [], ["mark", "doc_id"], {"n": "one"}).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.n for r in got) == list(range(2000))
    assert max(r["count"] for r in parts[0].groupBy("_part").count().collect()) < 1500


def brute_capacity(sizes, shards):
    best = sum(sizes)
    for cuts in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1):
        at = [0, *cuts, len(sizes)]
        best = min(best, max(sum(sizes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)))
    return best


@pytest.mark.parametrize("sizes,shards", [([5, 1, 1, 1, 9, 2, 2], 3), ([1] * 10, 4), ([100, 1, 1, 1], 3), ([7], 3), ([3, 3, 3, 3, 3, 3, 3], 2), ([10, 1, 10, 1, 10, 1, 10], 4)])
def test_cuts(spark, sizes, shards):
    ends = np.cumsum(sizes).tolist()
    table = spark.createDataFrame([(e,) for e in ends], "end long")
    capacity, cuts = sharding.minimax_cuts(table, ends[-1], max(sizes), shards)
    assert capacity == brute_capacity(sizes, shards)
    at = [0, *cuts, ends[-1]]
    assert at == sorted(at) and max(b - a for a, b in zip(at[:-1], at[1:], strict=True)) == capacity
    assert set(cuts) <= {0, *ends}


def test_shard(make):
    rng = random.Random(9)
    rows = [(i, "t" * rng.randint(0, 30) + str(rng.randint(0, 99))) for i in range(500)] + [(900 + i, "hot copy") for i in range(60)]
    out = sharding.shard(make(*rows)).collect()
    text = dict(rows)
    assert sorted(r.doc_id for r in out) == sorted(text)
    for r in out:
        assert r["size"] == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    assert all(len({r.shard for r in out if text[r.doc_id] == t}) == 1 for t in set(text.values()))
    loads = [sum(r["size"] for r in out if r.shard == k) for k in range(8)]
    assert max(loads) - min(loads) < 2 * 60 * 9
    for k in range(8):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))


def test_shard_odd_rows(odd, clashing):
    for docs in (odd, clashing):
        out = sharding.shard(docs).collect()
        assert len(out) == odd.count() and [r["size"] for r in out if r.doc_id == 3] == [1]
        assert len({r.shard for r in out if r["size"] == 1}) == 1
        for k in {r.shard for r in out}:
            assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    assert sharding.shard(odd.limit(0)).count() == 0
