"""Exact and near duplicates against brute force."""

import hashlib
import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from listforge.llm import exact_dedup, near_dedup
from listforge.llm.common import shingle_sets, word_hashes
from listforge.llm.components import components

from .conftest import words

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 85 * (len(sets[a]) + len(sets[b]) - inter):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_exact_groups(make):
    rows = [(i, f"text {i % 7}") for i in range(50)] + [(60, "Text 1"), (61, "text 1 "), (62, "alone")]
    docs = make(*rows)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.h) for r in exact_dedup.exact_dedup(docs, {"h": F.sha2("text", 256)}).collect()}
    for i, t in rows:
        same = [j for j, u in rows if u == t]
        assert got[i] == (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())


def test_exact_same_length_and_prefix(make):
    docs = make((1, "p" * 100 + "a"), (2, "p" * 100 + "b"), (3, "p" * 100 + "a"))
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(docs).collect()} == {(1, 3), (2, 2), (3, 3)}


def test_exact_without_broadcast(make, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", -1)
    docs = make((1, "a"), (2, "a"), (3, "b"), (4, "cc"))
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()) == [(1, 2, 2), (2, 2, 2), (3, 3, 1), (4, 4, 1)]
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(docs).collect()) == [2, 3, 4]


def test_exact_odd_rows(odd, clashing):
    for docs in (odd, clashing):
        rows = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()]
        assert len(rows) == odd.count()
        assert sorted(rows, key=str).count((2, 2, 4, True)) == 2  # both rows of the repeated one
        assert (1, 2, 4, False) in rows and (None, 2, 4, False) in rows
        assert (3, 4, 3, False) in rows and (4, 4, 3, True) in rows and (None, 4, 3, False) in rows
        assert (2, 2, 1, True) in rows  # the other text under the same id
    left = exact_dedup.drop_copies(odd)
    assert left.columns == odd.columns
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in left.collect()) == sorted([
        (2, "a b c"), (2, "anoth"), (4, ""), (5, "w0 w1"), (6, "w0 w1"), (7, " \n\t "), (9, "é ß 😀"), (10, "one")])
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


def test_repeated_rows_and_nameless_copies_go(make):
    docs = make(*[(1, "same text here")] * 3, (None, "no id"), (None, "no id"), (None, "no id too"), (2, "same text here"), (2, "same text here"), (None, ""), (None, None))
    assert sorted((str(r.doc_id), r.text) for r in exact_dedup.drop_copies(docs).fillna("", "text").collect()) == [
        ("2", "same text here"), ("None", ""), ("None", "no id"), ("None", "no id too")]
    near = make(*[(1, "a b c d e f g")] * 3, (1, "other words stand in this text"), (None, "x y z u v w"), (None, "x y z u v w"), (5, ""), (6, None))
    left = near_dedup.keep_one(near)
    assert left.columns == near.columns and sorted((str(r.doc_id), r.text or "") for r in left.collect()) == [
        ("1", "a b c d e f g"), ("1", "other words stand in this text"), ("5", ""), ("6", ""), ("None", "x y z u v w")]


@pytest.mark.parametrize("bits", [exact_dedup.HEAD_BITS, 8])
def test_many_open_heads(make, monkeypatch, bits):
    """Beyond a list of heads, bits say which texts are hashed whole; shared bits change nothing."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["x" * 70 + str(i % 9), str(i % 40), "", f"own {i}", "y" * 100 + str(i)])) for i in range(400)]
    want = sorted(map(tuple, exact_dedup.exact_dedup(make(*rows)).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(exact_dedup, "HEAD_BITS", bits)
    assert sorted(map(tuple, exact_dedup.exact_dedup(make(*rows)).collect())) == want


def test_no_python_in_exact(make):
    plan = exact_dedup.exact_dedup(make((1, "a")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_word_hashes_of_long_texts():
    rng = random.Random(1)
    text = " ".join(words(rng, 400_000)).encode()
    whole, again = word_hashes(text), word_hashes(text + b" \n")
    assert len(whole) == len(text.split()) and (whole == again).all()
    one = b"x" * 3_000_000
    assert len(word_hashes(one)) == 1 and len(word_hashes(b"a " + one + b" b c")) == 4


def test_shingle_counts():
    texts = ["", " \n", "a", "a b c d", "A b c d e", "a b c d e", "a b c d e f a b c d e f", "ÉA é"]
    got = shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert list(got[4]) == list(got[5]) and list(got[2]) != list(got[3])


@pytest.fixture(scope="module")
def families():
    """Unrelated texts, near copies at and around the threshold, a shared passage, and a large group of near copies."""
    rng = random.Random(7)
    passage = words(rng, 60)
    rows = []
    for _ in range(40):
        base = words(rng, rng.randint(30, 160))
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
            rows.append(" ".join(w))
    for _ in range(70):
        own = words(rng, 25)
        rows.append(" ".join(own[:12] + passage + own[12:]))
    base = words(rng, 200)
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = words(rng, 1)[0]
        rows.append(" ".join(w))
    rows += ["", "", "few words", "few words", "Few Words"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_groups(make, families):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(make(*families)).collect()}
    want = brute_components([(i, t) for i, t in families])
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


@pytest.mark.parametrize("leaf", [near_dedup.LEAF, 1])
def test_near_contained(make, monkeypatch, leaf):
    """Truncated and extended copies just above the threshold, in shallow nodes and in those of the deepest level."""
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    rng = random.Random(11)
    rows = []
    for i in range(400):
        base = [f"{w}{i}" for w in words(rng, 204)]
        cut = rng.randint(174, 184)
        rows += [" ".join(base), " ".join(base[:cut] if i % 2 else base[204 - cut :])]
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(make(*enumerate(rows))).collect()}
    assert [i for i in range(0, 800, 2) if got[i + 1] != i] == []


@pytest.mark.parametrize("slice_rows,leaf,levels,dense", [(16, 2048, 8, True), (16, 4, 8, True), (4096, 3, 8, False), (16, 3, 2, False)])
def test_near_groups_in_slices_and_deep_trees(make, families, monkeypatch, slice_rows, leaf, levels, dense):
    """Small limits send the same texts through slices with pivots, loose tiles, and nodes of many levels."""
    for name, value in (("SLICE_ROWS", slice_rows), ("NODE_ROWS", slice_rows), ("SLICE_TOKENS", 100 * slice_rows), ("PIVOTS", 4), ("LEAF", leaf), ("LEVELS", levels), ("GROUP_ROWS", 100), ("GROUP_TOKENS", 5000)):
        monkeypatch.setattr(near_dedup, name, value)
    if not dense:
        monkeypatch.setattr(near_dedup, "STAYS", 2.0)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(make(*families)).collect()}
    want = brute_components([(i, t) for i, t in families])
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_links_of_long_sets(spark):
    """Groups above the token limit, of sets of very different sizes, against all pairs."""
    rng = np.random.default_rng(4)
    rows, sets = [], []
    for g in range(3):
        base = np.unique(rng.integers(0, 1 << 60, 3000))
        for k in range(25):
            s = np.unique(np.r_[base[rng.random(len(base)) > rng.choice([0.01, 0.08, 0.3])], rng.integers(0, 1 << 60, int(rng.integers(0, 400)))])
            rows.append((g, f"{g}-{k:02d}".encode(), len(s)))
            sets.append((f"{g}-{k:02d}".encode(), s.tolist()))
    payload = near_dedup.keep(spark.createDataFrame(sets, "cls binary, tokens array<bigint>"))
    table = near_dedup.keep(spark.createDataFrame(rows, "g long, cls binary, w long"))
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if a[:1] == b[:1] and 100 * len(set(x) & set(y)) >= 85 * len(set(x) | set(y))]
    want = dict(components(spark.createDataFrame(links, "a binary, b binary")).collect())
    for limit in (2_000_000, 20_000):
        near_dedup.SLICE_TOKENS, before = limit, near_dedup.SLICE_TOKENS
        small, large = near_dedup.links_in_groups(table, payload, 85, True)
        near_dedup.SLICE_TOKENS = before
        found = small if large is None else small.union(large)
        assert (large is None) == (limit == 2_000_000)
        assert {bytes(k): bytes(v) for k, v in dict(components(found).collect()).items()} == {bytes(k): bytes(v) for k, v in want.items()}


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_least_shared(percent):
    need = near_dedup.least_shared(percent) * near_dedup.SKETCH
    draws = np.random.default_rng(5).binomial(near_dedup.SKETCH, percent / 100, 1_000_000)
    assert (draws < need).sum() <= 10 and need > 1


def test_near_by_shuffle(make, families, monkeypatch):
    import listforge.llm.common as common

    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", -1)
    part = families[:60]
    want = brute_components(part)
    assert {r.doc_id for r in near_dedup.keep_one(make(*part)).collect()} == {i for i, (_, c) in want.items() if c == i}


def test_near_odd_rows(odd, clashing):
    for docs in (odd, clashing):
        rows = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(docs).collect()), key=str)
        assert len(rows) == odd.count()
        assert rows.count((2, 3, 1, False)) == 2 and (1, 3, 1, True) in rows and (None, 3, 1, False) in rows
        assert (3, 0, 3, True) in rows and (4, 0, 4, True) in rows and (7, 0, 7, True) in rows and (None, 0, None, True) in rows
        assert (8, 1, 8, True) in rows and (10, 1, 8, False) in rows and (2, 1, 2, True) in rows
        assert (6, 978, 5, False) in rows
    assert near_dedup.near_dedup(odd.limit(0)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (5, 6), (6, 5), (7, 7)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 501 + i) for i in range(30)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).distinct().collect())
    want = {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5} | {100 + i: 100 for i in range(41)} | {500 + i: 500 for i in range(31)}
    assert got == want


def _peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("exact", [True, False])
def test_memory_of_a_comparison_follows_its_tiles(exact):
    """A group of many tiles takes little more than its rows; the tiles are compared in lots and give the same links."""
    rng = np.random.default_rng(5)
    rows, width = (4000, 500) if exact else (40_000, 32)
    sets = np.sort(rng.integers(-(1 << 62), 1 << 62, (rows, width)), axis=1)
    sets[1::4] = sets[::4]  # two of each tile of four are equal
    rowed = pa.ListArray.from_arrays(np.arange(0, rows * width + 1, width, dtype=np.int32), pa.array(sets.ravel()))
    numbers = [b"%016d" % i for i in range(rows)]
    group = pa.table({"g": [b"%d" % (i // 4) for i in range(rows)], "i": [0] * rows, "j": [0] * rows, "cls": numbers, "tokens": rowed})
    out = []
    peak = _peak(lambda: out.append(near_dedup._linked(85, exact, True)(group)))
    links = set(zip(out[0]["a"].to_pylist(), out[0]["b"].to_pylist(), strict=True))
    assert links == {(numbers[i], numbers[i + d]) for i in range(0, rows, 4) for d in (0, 1)}
    assert peak < 3 * sets.nbytes


def test_memory_of_word_hashes_follows_no_text(rng):
    raw = " ".join(words(rng, 20_000)).encode() * 20
    word_hashes(raw[:1000])
    assert _peak(lambda: word_hashes(raw)) < 10 * len(raw)


def test_parts_of_batches():
    texts = ["a" * 300_000] * 5 + [None, "", "b" * 3_000_000] + ["c"] * 600
    parts = list(near_dedup._parts(iter([pa.record_batch({"text": pa.array(texts, pa.string())})])))
    assert [t for p in parts for t in p["text"].to_pylist()] == texts
    assert all(p.num_rows <= 256 and (p.num_rows == 1 or sum(len(t or "") for t in p["text"].to_pylist()) <= near_dedup.CHUNK_BYTES) for p in parts)


def test_batches_are_narrow_during_near_dedup(spark, make, monkeypatch):
    """Batches that go to Python hold few rows, and the session's own setting stands again afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), []
    kept = near_dedup.keep
    monkeypatch.setattr(near_dedup, "keep", lambda df, label: seen.append((label, int(spark.conf.get(name)))) or kept(df, label))
    rows = near_dedup.near_dedup(make((1, "a b c d e f"), (2, "a b c d e f"), (3, "x"))).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 1, 3: 3}
    assert all(n <= 1000 for label, n in seen if label in ("signatures", "sets", "links")) and seen[0][0] == "signatures"
    assert spark.conf.get(name) == before
