import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from listforge.llm import conversation_trie as ct

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def key(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest() + len(re.findall("[^\x20\x09-\x0d]+", text)).to_bytes(4, "big")


def brute(rows):
    """Node rows of (conv_id, turn, role, text) rows, by whole prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, key(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(x)] for c, x in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, p in paths.items():
        ends[p].append(c)
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
            if d:
                children[p[: d - 1]].add(p[:d])
    def below(node):
        leaves, saved = int(not children[node]), (len(members[node]) - 1) * (len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0)
        for child in children[node]:
            a, b = below(child)
            leaves, saved = leaves + a, saved + b
        return leaves, saved
    return sorted(((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), *below(node),
                    hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, m in list(members.items())), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def forest(rng, n):
    rows = []
    for c in range(n):
        if rng.random() < 0.15:
            continue  # families without their first conversation
        for turn in range(rng.randint(1, 7)):
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["hi there", "hi", "", None, "a b c", f"own {c}"])))
    return rows


@pytest.mark.parametrize("shard", [1, 9, 1 << 17])
def test_equals_brute_force(spark, rng, monkeypatch, shard):
    monkeypatch.setattr(ct, "SHARD", shard)
    rows = forest(rng, 150)
    assert result(ct.trie(table(spark, rows))) == brute(rows)


def test_copies_and_a_long_common_opening(spark, rng, monkeypatch):
    monkeypatch.setattr(ct, "SHARD", 40)
    monkeypatch.setattr(ct, "BLOCK", 7)
    rows = [(c, t, "user", "same words here") for c in range(0, 4000, 20) for t in range(3)]
    rows += [(c, t, "user", f"open {t}" if t < 30 else f"{c % 5} {t}") for c in range(10_000, 10_400, 20) for t in range(40)]
    assert result(ct.trie(table(spark, rows))) == brute(rows)


def test_odd_rows_clashing_names(spark):
    from pyspark.sql import functions as F

    rows = [(None, 1, "user", "nobody"), (0, None, None, None), (0, None, None, None), (0, 1, "user", "x " * 50_000), (0, 1, "user", "tie"), (1, 5, "", "y"), (7, 1, "a", "b"), (7, 1, "a", "b"),
            (23, 2, "ab", "c"), (24, 2, "a", "bc"), (-5, 1, "user", "minus"), (-20, 0, "user", "first"), (-20, 1, "user", "second")]
    df = table(spark, rows)
    want = [r for r in brute([r for r in rows if r[0] is None or r[0] >= 0])]
    assert result(ct.trie(df.filter("conv_id >= 0 or conv_id is null"))) == want
    for name in ("path", "key", "family", "own", "n", "depth", "saved", "end_id", "parent_key"):
        df = df.withColumn(name, F.lit("clash"))
    assert result(ct.trie(df.filter("conv_id >= 0 or conv_id is null"))) == want
    assert len(result(ct.trie(df))) > len(want)  # negative ids: the family follows the sign of the remainder
    assert result(ct.trie(df.limit(0))) == []


def test_double_array_finds_what_was_put(rng):
    paths = sorted({b"".join(key("u", str(rng.randint(0, 30 if d else 3000))) for d in range(rng.randint(0, 6))) for _ in range(4000)})
    trie, numbers = ct.packed(paths)
    inside = {p[: i * ct.TURN] for p in paths for i in range(len(p) // ct.TURN + 1)}
    assert (trie.check[: trie.end] >= 0).sum() == len(inside)  # one slot a node, the root included
    assert trie.end < 3 * len(inside) + len(numbers)
    import numpy as np
    for p in paths[::37]:
        slot = np.array([0])
        for i in range(0, len(p), ct.TURN):
            slot = trie.step(slot, np.array([numbers[p[i : i + ct.TURN]]]))
            assert slot[0] > 0
        missing = [n for t, n in numbers.items() if p + t not in inside][:5]
        assert all(trie.step(slot, np.array([n]))[0] == -1 for n in missing)
