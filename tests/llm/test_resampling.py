import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from listforge.llm import resampling

from .conftest import words


def brute(docs, target, percent=5, least=20, seed=42, buckets=10_000):
    """doc_id, n_features, weight, score, rank of (doc_id, text) rows, feature by feature."""
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    own = [features(text) for _, text in docs]
    s = Counter(b for _, f in own for b in f)
    t = Counter(b for text in target for b in features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets)))) for b in s}
    rows = []
    for (doc_id, _), (n, f) in zip(docs, own, strict=True):
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def target(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def test_equals_brute_force(spark, make, rng):
    docs = [(i, " ".join(words(rng, rng.randint(0, 60)))) for i in range(400)] + [(400 + i, "The  LAST—word, the last word 7 é日本 _x " * 6) for i in range(20)]
    aims = [" ".join(words(rng, 50)), "the last word of all", None]
    assert result(resampling.resample(make(*docs), target(spark, aims))) == brute(docs, aims)


def test_odd_rows_clashing_names(spark, odd, clashing):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    aims = ["w1 w2 w3", "one"]
    want = brute(docs, aims, percent=50, least=5)
    assert result(resampling.resample(odd, target(spark, aims), percent=50, least_words=5)) == want
    assert result(resampling.resample(clashing, target(spark, aims), percent=50, least_words=5)) == want


def test_repeated_rows_rank_one_by_one(make, spark):
    docs = [(1, "same text " * 20)] * 200 + [(2, "other words " * 20)] * 200
    got = resampling.resample(make(*docs), target(spark, ["same"]), percent=10).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert ranks == list(range(1, 41)) and {r["doc_id"] for r in got if r["rank"]} == {max(got, key=lambda r: r["score"])["doc_id"]}


def test_empty_tables(make, spark):
    none = make((1, "x")).limit(0)
    assert result(resampling.resample(none, target(spark, ["a"]))) == []
    docs = [(i, f"word{i} " * 25) for i in range(40)]
    assert result(resampling.resample(make(*docs), target(spark, ["a"]).limit(0))) == brute(docs, [])


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_pieces_change_nothing(size, monkeypatch):
    text = ("Ab c1é,日本x  " + "y" * 90 + "  _z. ") * 40
    whole = resampling.Features(10_000)(text.encode())
    monkeypatch.setattr(resampling, "pieces", lambda raw, _p=resampling.pieces: _p(raw, size))
    cut = resampling.Features(10_000)(text.encode())
    assert cut[0] == whole[0] and sorted(cut[1].tolist()) == sorted(whole[1].tolist())


def test_drawn_documents_keep_their_columns(make, spark):
    docs = make(*[(i, f"word{i % 7} and more " * 10, f"s{i}") for i in range(100)])
    got = resampling.draw(docs, target(spark, ["word3 and more"]))
    assert got.columns == docs.columns and got.count() == 5
