"""Pieces by an exact round trip; packings by their laws and a lower bound."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from listforge.llm import packing
from listforge.llm.queries import vocabulary_path

TEXTS = ["", None, "plain words, here. And there", "line\nbreaks\n\nand  blanks ", " lead", "\nlead", "tab\there and there", "é ß 😀 naïve — dash",
         "<|endoftext|> is text", "a\n b\n\nc \n d", "don't we'll I'm", "x" * 5000, "word " * 3000, "1234 5 67.8%", "end\n", "a \n", "Zeile\nNeu\nWort"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    t.encode_special_tokens = True
    return t


def test_pieces_round_trip(make, tokenizer):
    rows = packing.token_pieces(make(*enumerate(TEXTS)), vocabulary_path()).collect()
    for i, text in enumerate(TEXTS):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert sum((np.frombuffer(r.ids, "<u4").tolist() for r in own), []) == want
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own[:-1]]).tolist()
        assert all(r.length == 1024 for r in own[1:]) and 1 <= own[0].length <= 1024 and len(own) == -(-len(want) // 1024)


def check(rows, lengths, length):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    assert sorted(r.length for r in rows) == sorted(lengths)
    return len(bins)


@pytest.mark.parametrize("lengths,most", [
    ([1024] * 3 + [512] * 4 + [1], 6), ([], 0), ([5], 1), ([600] * 9 + [424] * 9, 9), ([700, 324] * 50 + [200] * 100, 50 + 20),
    (np.random.default_rng(1).integers(1, 1025, 3000).tolist(), None), (np.random.default_rng(2).integers(20, 200, 4000).tolist(), None),
])
def test_pack(spark, lengths, most):
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "item long, length long")
    used = check(packing.pack(items).collect(), [int(n) for n in lengths], 1024)
    lower = -(-sum(lengths) // 1024)
    large = sum(n > 512 for n in lengths)
    assert used <= (most if most is not None else max(lower, large) * 1.02 + 1)


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 1000, 300)
    people = [packing._new(sizes, 1024, rng, noise) for noise in (0.0, 0.2, 0.4)]
    for mother in people:
        for father in people:
            child = packing._cross(sizes, mother, father, 1024, rng)
            assert (child >= 0).all() and np.bincount(child, sizes).max() <= 1024
            # Whole bins of the father live on.
            groups = lambda b: {tuple(np.flatnonzero(b == k)) for k in np.unique(b)}
            assert groups(child) & groups(father)


def test_odd_rows(odd, clashing):
    for docs in (odd, clashing):
        pieces = packing.token_pieces(docs, vocabulary_path()).drop("ids")
        out = packing.pack_pieces(pieces)
        rows = out.collect()
        assert check(rows, [r.length for r in pieces.collect()], 1024) >= 1
        assert {r.doc_id for r in rows} == {r.doc_id for r in odd.select("doc_id").collect()}
        assert sum(r.doc_id == 2 and r.piece == 0 for r in rows) == 3
    assert packing.pack_pieces(packing.token_pieces(odd.limit(0), vocabulary_path())).count() == 0


def test_encoder_equals_the_tokenizer(tokenizer):
    rng = random.Random(4)
    alphabet = ["a", "B", "é", "ß", "ö", " ", " ", " ", "\n", "1", "²", ".", "#", "'s", "'ll", "Я", "中", "\u00a0", "\t", "😀", "--", "x" * 40]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["word" * 5000, " " * 3000 + "a", "\n" * 3000]
    for checked in (0, 10_000):
        encode = packing._Encoder(vocabulary_path(), checked)
        got = [np.frombuffer(x, "<u4").tolist() for x in encode(texts)]
        assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert encode.ranks is not None


def test_words_of_a_batch_are_merged_once():
    """Encoding follows the distinct words, not the text (F1)."""
    class Counting:
        def __init__(self, ranks):
            self.ranks, self.seen = ranks, 0

        def __getattr__(self, name):
            def call(text, *more):
                self.seen += len(text)
                return getattr(self.ranks, name)(text, *more)
            return call

    rng = random.Random(6)
    texts = [" ".join(f"word{rng.randrange(300)}" for _ in range(500)) for _ in range(200)]
    encode = packing._Encoder(vocabulary_path(), 0)
    encode.ranks = Counting(encode.ranks)
    once = encode(texts)
    first = encode.ranks.seen
    assert 0 < first < sum(map(len, texts)) / 50
    assert encode(texts) == once and encode.ranks.seen < 2 * first


def test_split_equals_the_pattern():
    import regex

    rng = random.Random(9)
    alphabet = ["a", "B", "é", "ß", "Я", " ", " ", "\n", "\t", "\r", "\v", "1", "²", "½", ".", "#", "'", "'s", "'re", "'ve", "'ll", "l", "r", "e", "d", "_", "\u0301"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    kind = packing._kinds(raw)
    assert not (kind == packing._AWKWARD).any()
    begins = packing._begins(raw, kind, offsets).tolist()
    words = [raw[a:b].tobytes().decode() for a, b in zip(begins, [*begins[1:], len(raw)])]
    assert words == [w for t in texts for w in regex.findall(packing._SPLIT, t)]


@pytest.mark.parametrize("text_bytes,word_bytes", [(1, 1), (40, 300), (200, 5000)])
def test_parts_of_long_texts_and_forgotten_words(tokenizer, monkeypatch, text_bytes, word_bytes):
    monkeypatch.setattr(packing, "TEXT_BYTES", text_bytes)
    monkeypatch.setattr(packing, "WORD_BYTES", word_bytes)
    rng = random.Random(10)
    alphabet = ["a", "bc", "é", "Я", " ", " ", "  ", "\n", "\r\n", "\t", "12", ".", "'s", "'ll ", " '"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(200)] + ["x" * 900, " " * 900, "a b c " * 200 + "中", "中 " + "a b " * 200]
    encode = packing._Encoder(vocabulary_path(), 0)
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [encode([t])[0] for t in texts] == want and encode(texts) == want


def test_very_long_words(tokenizer):
    texts = ["x" * 300_000, " " * 300_000, "\n" * 300_000 + "a", "a" + "\t" * 300_000, "." * 300_000, "ab c " * 700_000]
    encode = packing._Encoder(vocabulary_path(), 0)
    assert [encode([t])[0] for t in texts] == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_every_character_that_is_not_awkward(tokenizer):
    texts = [f"a{c}1{c}.{c}{c} {c}a\n{c}'{c}s é{c}ß²{c}" for c in map(chr, range(0x530))]
    encode = packing._Encoder(vocabulary_path(), 0)
    assert encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert sum(ids is not None for ids in encode._by_words(packing.pa.array(texts))) > 1200


def test_other_vocabularies_go_to_the_tokenizer(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "v.json"))
    encode = packing._Encoder(str(tmp_path / "v.json"))
    assert encode.ranks is None and np.frombuffer(encode(["a b c"])[0], "<u4").tolist() == [0, 1, 2]


def test_exact_fill_and_mending_keep_every_item():
    rng = np.random.default_rng(8)
    for sizes in (rng.integers(1, 1024, 500), rng.integers(1, 60, 500), np.full(7, 1000), np.array([1, 1, 1022]), np.array([5])):
        bins = packing._exact(sizes, 1024)
        mended = packing._mend(sizes, bins, 1024, 0, rng)
        for b in (bins, mended):
            assert (b >= 0).all() and np.bincount(b, sizes).max() <= 1024
        assert len(np.unique(mended)) <= len(np.unique(bins))


def test_fewer_sequences_than_best_fit(spark):
    """On the given documents the evolved packing beats plain best fit of all pieces in decreasing order."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = packing.pack_pieces(packing.token_pieces(docs, vocabulary_path()).select("doc_id", "piece", "length")).collect()
    sizes = np.array([r.length for r in rows])
    fill: list[int] = []
    packing._best_fit(sizes, packing._decreasing(sizes, np.arange(len(sizes))), np.full(len(sizes), -1), fill, 1024)
    used = check(rows, sizes.tolist(), 1024)
    assert -(-int(sizes.sum()) // 1024) <= used < len(fill)


def test_digest(make):
    row = packing.token_pieces(make((1, "")), vocabulary_path()).select(F.crc32("ids").alias("c")).first()
    import zlib

    assert row.c == zlib.crc32(np.array([2], "<u4").tobytes())
