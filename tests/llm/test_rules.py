import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from listforge.llm import rules

from .conftest import words

SPACE = "[^\x20\x09-\x0d]+"


def brute(text):
    text = text or ""
    w = re.findall(SPACE, text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    inside = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def some_texts(rng):
    out = ["", " \n\t ", "one", "é ß 😀 one", "\xa0 x y", "a\x00b", "a b c d e f g h " * 3, "x " * 9, "l 1\nl 1\nl 1 \n\n \nl 2\r\nl 2\r"]
    for _ in range(60):
        w = words(rng, rng.randint(1, 40))
        out.append(rng.choice([" ", "\n", "  ", " # "]).join(w + w[: rng.randint(0, 20)]) + rng.choice(["", "\n" + "\n".join(w[:3] * 2)]))
    return out


def test_statistics_equal_brute_force(rng):
    texts = some_texts(rng)
    got = list(zip(*[rules.STATISTICS[s]([t.encode() for t in texts]).tolist() for s in rules.BASE_STATISTICS], strict=True))
    assert got == [brute(t) for t in texts]


@pytest.mark.parametrize("size", [5, 40, 300])
def test_pieces_and_groups_change_nothing(size, rng, monkeypatch):
    texts = [t.encode() for t in some_texts(rng)]
    whole = {s: f(texts).tolist() for s, f in rules.STATISTICS.items()}
    monkeypatch.setattr(rules, "CHUNK_BYTES", size)
    monkeypatch.setattr(rules, "pieces", lambda raw, _p=rules.pieces: _p(raw, size))
    assert {s: f(texts).tolist() for s, f in rules.STATISTICS.items()} == whole


def test_cascade_stops_early_and_order_changes_no_verdict(rng):
    texts = [t.encode() for t in some_texts(rng)]
    every = np.arange(len(texts))
    fails = {r.name: r.fails(*[rules.STATISTICS[n](texts) for n in r.needs]) for r in rules.RULES}
    for _ in range(5):
        shuffled = random.Random(rng.random()).sample(rules.RULES, len(rules.RULES))
        measured = rules.Measured(texts)
        verdict = rules.cascade(measured, shuffled)
        for i in every:
            failed = [k for k, r in enumerate(shuffled) if fails[r.name][i]]
            assert verdict[i] == (failed[0] if failed else -1)
        last = shuffled[-1]
        alive = np.flatnonzero((verdict < 0) | (verdict == len(shuffled) - 1))
        only = [n for n in last.needs if not any(n in r.needs for r in shuffled[:-1])]
        assert all(measured.known[n].sum() == len(alive) for n in only)


def test_cheap_and_selective_rules_come_first(make):
    def slow(n):
        time.sleep(0.2)
        return n > 0

    costly = rules.Rule("costly", ("n_lines",), slow)
    never = rules.Rule("never", ("n_lines",), lambda n: n < 0)
    half = rules.Rule("half", ("n_words",), lambda n: n < 2)
    docs = make(*[(i, "one" if i % 2 else "one two") for i in range(200)]).coalesce(1)
    assert [r.name for r in rules.order(docs, (never, costly, half))] == ["half", "costly", "never"]
    assert len(rules.order(docs.limit(0), rules.RULES)) == len(rules.RULES)


def test_odd_rows_clashing_names(odd, clashing):
    for docs in (odd, clashing):
        got = rules.judge(docs, rules.order(docs), rules.BASE_STATISTICS).collect()
        want = [(r["doc_id"], *brute(r["text"])) for r in odd.filter("length(text) < 1000 or text is null").collect()]
        assert sorted((tuple(r[:6]) for r in got if r["n_words"] < 1000), key=str) == sorted(want, key=str)
        long = [r for r in got if r["n_words"] >= 1000]
        assert sorted(r["n_repeat_words"] for r in long) == [60_000, 60_000]
        assert all(r["rejected_by"] for r in got)
    assert rules.judge(odd.limit(0), rules.RULES).count() == 0


def test_kept_documents(make, rng):
    good = [" ".join(words(rng, 60)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(good)] + [(100, "buy now ! " * 50), (101, "short"), (102, " | ".join(words(rng, 60))), (103, " ".join(words(rng, 60)).upper()), (None, good[0])]
    docs = make(*rows)
    kept = rules.kept(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(20))
    assert rules.judge(docs, rules.RULES).filter(F.col("doc_id").isNull() & F.col("rejected_by").isNull()).count() == 1
