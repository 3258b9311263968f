"""Packing token sequences by a grouping genetic algorithm on islands."""

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

LENGTH, END = 1024, 2
#: Items of one block (a subproblem), islands that evolve it, rounds between migrations.
BLOCK, ISLANDS, MIGRATIONS = 16384, 2, 2
POPULATION, CHILDREN = 4, 6
#: Openings of a few sequences that a child is mended by, at most.
MENDS = 150
#: A bin that is injected, or left alone by a crossing, is filled so far. Sequences that are not quite full are opened
#: again after a block and packed with those of other blocks, so many times.
FULL, REPACKS = 0.98, 6
SEED = 3
#: How a byte-level vocabulary splits texts before its merges.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text encoded at once, and of the words that a Python worker remembers the ids of.
TEXT_BYTES, WORD_BYTES = 1 << 20, 1 << 20
#: White space of more characters goes to the tokenizer.
SHORT = 256
#: Kinds of characters that the split tells apart. Awkward are unprintable ones and scripts beyond Cyrillic, on which libraries may differ.
_LETTER, _NUMBER, _OTHER, _BLANK, _WHITE, _AWKWARD = range(6)
_WHITES = " \t\n\v\f\r"


def _kind(c: str) -> int:
    if c in _WHITES:
        return _BLANK if c == " " else _WHITE
    if not c.isprintable() or c > "\u052f":
        return _AWKWARD
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(c)[0], _OTHER)


#: Kinds of the characters of one or two bytes in UTF-8, and of single bytes.
_KINDS = np.array([_kind(chr(c)) for c in range(0x800)], np.uint8)
_BYTE_KINDS = np.where(np.arange(256) < 128, _KINDS[:256], _AWKWARD).astype(np.uint8)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def _kinds(raw: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte of UTF-8 belongs to."""
    kind = _BYTE_KINDS[raw]
    lead = np.flatnonzero((raw >= 0xC0) & (raw < 0xE0))
    kind[lead] = kind[lead + 1] = _KINDS[(raw[lead] & 0x1F).astype(np.int32) << 6 | raw[lead + 1] & 0x3F]
    return kind


def _begins(raw: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin in texts that follow each other from ``offsets`` on, cut as _SPLIT does. No byte lies between words."""
    first = np.zeros(len(raw) + 2, bool)  # also the end, and what a look two bytes ahead may meet
    first[offsets] = first[-1] = True
    begins = first[:-2].copy()
    begins[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != _BLANK)  # a blank goes with what follows
    white = (kind == _BLANK) | (kind == _WHITE)
    inner = np.flatnonzero(white[1:] & white[:-1] & ~first[1:-2]) + 1
    # Of more white space only the last character is parted, and not at the end of a text.
    begins[inner] = ~first[inner + 1] & ~white[np.minimum(inner + 1, len(raw) - 1)]
    quote = np.flatnonzero(begins & (raw == ord("'")) & ~first[1:-1])
    one = raw[quote + 1]
    two = np.where(first[quote + 2], 0, raw[np.minimum(quote + 2, len(raw) - 1)])
    short = np.isin(one, list(b"stmd"))
    long = np.isin(one, list(b"rv")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    begins[quote[short | long] + 1] = False
    for after in (quote[short] + 2, quote[long] + 3):
        begins[after[after < len(raw)]] = True
    return np.flatnonzero(begins)


def _parts(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of a text of about TEXT_BYTES. They end where white space follows something else: no word depends on what lies beyond."""
    at = 0
    while at < len(raw):
        size, end = TEXT_BYTES, len(raw)
        while at + size < len(raw):
            white = np.isin(_BYTE_KINDS[raw[at : at + size]], (_BLANK, _WHITE))
            cuts = np.flatnonzero(white[1:] & ~white[:-1])
            if len(cuts):
                end = at + int(cuts[-1]) + 1
                break
            size *= 2
        yield at, end
        at = end


def _gathered(at: np.ndarray, count: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The ``count`` ids from each place ``at`` on, one after the other."""
    upto = np.cumsum(count)
    place = np.repeat(at - upto + count, count)
    place += np.arange(len(place), dtype=place.dtype)
    return ids[place]


#: No words, with the number of ids of each and the ids.
NOTHING = pa.array([], pa.binary()), np.empty(0, np.int64), np.empty(0, "<u4")


class _Encoder:
    """Token ids of texts by one vocabulary file.

    A byte-level vocabulary whose merges are numbered in their order also is a table of ranks, which the
    merger of another library walks faster; the words of ordinary texts go there, each distinct one of a batch once. Texts
    with awkward characters, and vocabularies of any other kind, go to the tokenizer. ``checked`` texts go both ways and must agree.
    """

    def __init__(self, vocabulary: str, checked: int = 64):
        self.vocabulary, self.checked, self.tokenizer = vocabulary, checked, None
        self.known = NOTHING
        with open(vocabulary, encoding="utf-8") as f:
            self.ranks = _ranks(json.load(f))

    def _whole(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        if self.tokenizer is None:  # many workers never need it again after the check
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.vocabulary)
            self.tokenizer.encode_special_tokens = True
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of distinct words, and all ids: one call for all, a line break between them."""
        text = pc.binary_join_element_wise(words, b"", b"\n")
        ids = self.ranks.encode_to_numpy(b"".join(text.to_numpy(zero_copy_only=False)).decode())
        ends = ids == self.ranks.encode_single_token(b"\n")
        return np.diff(np.flatnonzero(ends), prepend=-1) - 1, ids[~ends]

    def _words(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each of some distinct words begin, how many there are, and the ids; the new words are remembered."""
        known, count, ids = self.known
        place = pc.index_in(words, known)
        new = words.filter(place.is_null())
        blank = pc.is_in(pc.binary_slice(new, -1), pa.array([c.encode() for c in _WHITES], pa.binary()))
        whites = new.filter(blank)
        parts = [self._merged(new.filter(pc.invert(blank)))]
        for w in whites.to_pylist():  # the merger's pattern fails on very much white space
            one = self.ranks.encode_to_numpy(w.decode()) if len(w) <= SHORT else np.frombuffer(self._whole([w.decode()])[0], "<u4")
            parts.append((np.array([len(one)]), one))
        known = pa.concat_arrays([known, new.filter(pc.invert(blank)), whites])
        count, ids = np.concatenate([count, *[p[0] for p in parts]]), np.concatenate([ids, *[p[1] for p in parts]]).astype("<u4")
        place = pc.index_in(words, known).to_numpy()
        begin = np.cumsum(count) - count
        found = begin[place], count[place], ids
        if known.nbytes > WORD_BYTES:  # the words at hand are the likeliest to come again
            known, count, ids = NOTHING if words.nbytes > WORD_BYTES else (words, count[place], _gathered(*found))
        self.known = known, count, ids
        return found

    def _ids(self, raw: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
        """Ids of ordinary texts that follow each other in ``raw`` from ``offsets`` on, None for the others."""
        if not len(raw):
            return [b""] * (len(offsets) - 1)
        kind = _kinds(raw)
        plain = np.ones(len(offsets) - 1, bool)
        plain[np.searchsorted(offsets, np.flatnonzero(kind == _AWKWARD), "right") - 1] = False
        if not plain.all():
            sizes = np.diff(offsets)
            ids = iter(self._ids(raw[np.repeat(plain, sizes)], np.r_[0, np.cumsum(sizes[plain])]))
            return [next(ids) if p else None for p in plain]
        begins = _begins(raw, kind, offsets)
        ends = pa.py_buffer(np.r_[begins, len(raw)].astype(np.int32))
        words = pa.Array.from_buffers(pa.binary(), len(begins), [None, ends, pa.py_buffer(raw)]).dictionary_encode()
        at, count, ids = self._words(words.dictionary)
        index, starts = words.indices.to_numpy(), np.searchsorted(begins, offsets)
        del kind, begins, words
        cuts = np.r_[0, np.cumsum(count[index])][starts].tolist()
        found = _gathered(at[index], count[index], ids)
        return [found[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _by_words(self, texts: pa.StringArray) -> list[bytes | None]:
        """Ids of ordinary texts, None for the others. One long text is read in parts, so memory follows its ids alone."""
        offsets = np.r_[0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)]
        if not offsets[-1]:
            return [b""] * len(texts)
        start = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[start : start + offsets[-1]]
        if len(texts) > 1:
            return self._ids(raw, offsets)
        out = []
        for a, b in _parts(raw):
            out += self._ids(raw[a:b], np.array([0, b - a]))
            if out[-1] is None:
                return [None]
        return [b"".join(out)]

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = texts.cast(pa.string()).fill_null("") if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out = [None] * len(texts) if self.ranks is None else self._by_words(texts)
        rest = [i for i, ids in enumerate(out) if ids is None]
        if self.checked and len(rest) < len(texts):
            others = set(rest)
            some = [i for i in range(len(texts)) if i not in others][: self.checked]
            self.checked -= len(some)
            if self._whole(texts.take(pa.array(some)).to_pylist()) != [out[i] for i in some]:
                self.ranks = None  # the vocabulary is of another kind after all
                return self._whole(texts.to_pylist())
            if self.checked <= 0 and not rest:
                self.tokenizer = None
        for i, ids in zip(rest, self._whole(texts.take(pa.array(rest, pa.int64())).to_pylist()), strict=True):
            out[i] = ids
        return out


def _ranks(rules: dict):
    """The merger for a vocabulary file's rules, None if they are no plain byte-level ones."""
    import tiktoken

    split, model = rules.get("pre_tokenizer") or {}, rules["model"]
    if rules.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or model.get("type") != "BPE" or model.get("ignore_merges"):
        return None
    letters = {c: b for b, c in _byte_letters().items()}
    special = {t["content"] for t in rules.get("added_tokens", [])}
    vocab = {t: k for t, k in model["vocab"].items() if t not in special}
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if any(set(t) - set(letters) for t in vocab) or set(letters) - set(vocab) or None in merged or merged != sorted(merged) or sorted(vocab.values()) != list(range(len(vocab))):
        return None
    return tiktoken.Encoding("vocabulary", pat_str=_SPLIT, mergeable_ranks={bytes(letters[c] for c in t): k for t, k in vocab.items()}, special_tokens={})


_encoders: dict[str, _Encoder] = {}


def _encoder(vocabulary: str) -> _Encoder:
    """One for all tasks of a Python worker. Where the driver's path is not there, the worker looks for the file of that name itself."""
    if vocabulary not in _encoders:
        path = vocabulary
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(os.path.basename(vocabulary))
        _encoders[vocabulary] = _Encoder(path)
    return _encoders[vocabulary]


def _pieces(vocabulary: str, length: int, end: int):
    closing = np.array([end], "<u4").tobytes()

    def pieces(batch: pa.RecordBatch, encode: _Encoder) -> pa.RecordBatch:
        out = [[], [], [], [], []]
        for row, ids in enumerate(encode(batch.column("text"))):
            ids += closing
            n = len(ids) // 4
            # The first piece takes the odd length, all others are full.
            cuts = [0, *range((n - 1) % length + 1, n + 1, length)]
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                for c, x in zip(out, (row, k, a, b - a, ids[4 * a : 4 * b]), strict=True):
                    c.append(x)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())],
                                          names=["doc_id", "piece", "start", "length", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
            total, at = np.cumsum(sizes, dtype=np.int64), 0
            while at < batch.num_rows:  # rows of TEXT_BYTES together, one at least
                end = max(at + 1, int(np.searchsorted(total, total[at] - sizes[at] + TEXT_BYTES, "right")))
                yield pieces(batch.slice(at, end - at), encode)
                at = end

    return run


def token_pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of every document's ids and a closing id: doc_id, piece, start, length, ids (little-endian 32-bit).

    Documents of more than ``length`` ids are cut so that only the first piece is shorter. A null or empty text has
    the closing id alone. Strings of special tokens are ordinary text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_pieces(vocabulary, length, end), f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


# -- the genetic algorithm; an individual is the bin number of each item --

def _best_fit(sizes: np.ndarray, todo: np.ndarray, bins: np.ndarray, fill: list[int], length: int) -> None:
    """Put each item of ``todo`` in turn into the fullest bin that holds it, or a new one."""
    room: list[list[int]] = [[] for _ in range(length + 1)]
    mask = 0
    for b, f in enumerate(fill):
        if 0 < f < length:
            room[length - f].append(b)
            mask |= 1 << (length - f)
    for i in todo.tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            left, b = length, len(fill)
            fill.append(0)
        bins[i] = b
        fill[b] += size
        left -= size
        if left:
            room[left].append(b)
            mask |= 1 << left


def _decreasing(sizes: np.ndarray, items: np.ndarray, rng=None, noise: float = 0.0) -> np.ndarray:
    key = sizes[items] * (1 + noise * rng.standard_normal(len(items))) if noise else sizes[items]
    return items[np.argsort(-key, kind="stable")]


def _new(sizes: np.ndarray, length: int, rng, noise: float) -> np.ndarray:
    bins = np.full(len(sizes), -1)
    _best_fit(sizes, _decreasing(sizes, np.arange(len(sizes)), rng, noise), bins, [], length)
    return bins


def _exact(sizes: np.ndarray, length: int) -> np.ndarray:
    """Bins that each begin with the largest item left and are filled by one, two or three others that fit exactly; where
    none do, by the largest that fits."""
    held: list[list[int]] = [[] for _ in range(length + 1)]
    for i in np.argsort(sizes, kind="stable")[::-1].tolist():
        held[sizes[i]].append(i)
    count = np.array([len(h) for h in held])
    bins, number, top, left = np.full(len(sizes), -1), 0, length, len(sizes)
    while left:
        while not count[top]:
            top -= 1
        room, chosen = length - top, [top]
        count[top] -= 1
        while room:
            more = [room] if count[room] else _two(count, room) or _three(count, room)
            if not more:
                fits = np.flatnonzero(count[: room + 1])
                if not len(fits):
                    break
                more = [int(fits[-1])]
            for size in more:
                count[size] -= 1
                room -= size
            chosen += more
        for size in chosen:
            bins[held[size].pop()] = number
        left -= len(chosen)
        number += 1
    return bins


def _two(count: np.ndarray, room: int) -> list[int]:
    """Two sizes at hand that fill the room exactly, one as large as possible."""
    large = np.arange(room - 1, (room - 1) // 2, -1)
    if not len(large):
        return []
    fine = np.flatnonzero((count[large] > 0) & (count[room - large] > (large == room - large)))
    return [int(large[fine[0]]), room - int(large[fine[0]])] if len(fine) else []


def _three(count: np.ndarray, room: int, tries: int = 40) -> list[int]:
    for size in np.flatnonzero(count[:room])[::-1][:tries].tolist():
        count[size] -= 1
        rest = _two(count, room - size) if room > size else []
        count[size] += 1
        if rest:
            return [size, *rest]
    return []


def _mend(sizes: np.ndarray, bins: np.ndarray, length: int, lower: int, rng) -> np.ndarray:
    """Open a few bins that are not full and a few others and place their items anew, as long as that is no worse."""
    bins = np.unique(bins, return_inverse=True)[1]
    for _ in range(MENDS):
        fill = np.bincount(bins, sizes).astype(np.int64)
        loose = np.flatnonzero(fill < length)
        if len(fill) <= lower or not len(loose):
            break
        chosen = np.unique(np.r_[rng.choice(loose, min(len(loose), int(rng.integers(2, 12))), replace=False), rng.integers(0, len(fill), int(rng.integers(1, 12)))])
        todo = np.flatnonzero(np.isin(bins, chosen))
        again, new = np.full(len(sizes), -1), []
        _best_fit(sizes, _decreasing(sizes, todo, rng, float(rng.choice([0.0, 0.02, 0.1, 0.3]))), again, new, length)
        if len(new) < len(chosen) or len(new) == len(chosen) and (np.array(new) ** 2).sum() >= (fill[chosen] ** 2).sum():
            bins[todo] = chosen[again[todo]]
            bins = np.unique(bins, return_inverse=True)[1]
    return bins


def _fitness(sizes: np.ndarray, bins: np.ndarray, length: int) -> tuple[int, float]:
    """Fewer bins first; among equals, rather full and empty bins than half-full ones."""
    fill = np.bincount(bins, sizes)
    fill = fill[fill > 0]
    return -len(fill), float(((fill / length) ** 2).sum())


def _cross(sizes: np.ndarray, mother: np.ndarray, father: np.ndarray, length: int, rng) -> np.ndarray:
    """Whole well-filled bins of the father go into the mother; bins they collide with are opened and their other items placed by best fit."""
    fill = np.bincount(father, sizes)
    good = np.flatnonzero(fill >= FULL * length)
    if not len(good):
        good = np.argsort(-fill)[: max(1, len(fill) // 4)]
    chosen = rng.choice(good, max(1, len(good) // 2), replace=False)
    injected = np.isin(father, chosen)
    hit = np.unique(mother[injected])
    child = np.full(len(sizes), -1)
    stay = ~np.isin(mother, hit)
    # The mother's weakest bins are opened as well, else a child could only get worse.
    weak = np.bincount(mother, sizes)
    stay &= weak[mother] >= FULL * length
    _, child[injected] = np.unique(father[injected], return_inverse=True)
    if stay.any():
        child[stay] = np.unique(mother[stay], return_inverse=True)[1] + child.max() + 1
    full = np.bincount(child[child >= 0], sizes[child >= 0]).astype(int).tolist()
    _best_fit(sizes, _decreasing(sizes, np.flatnonzero(child < 0)), child, full, length)
    return child


def _evolve(length: int, migration: int):
    def run(key, table):
        """One island of one block: its own start, or the elites sent to it; one elite leaves."""
        block, island = (k.as_py() for k in key)
        item = table.column("item").to_numpy()
        order = np.lexsort((table.column("elite").to_numpy(), item)) if migration else np.argsort(item)
        if migration:  # two elites per item: the island's own and the neighbour's
            per = len(np.unique(table.column("elite").to_numpy()))
            item = item[order].reshape(-1, per)[:, 0]
            sizes = table.column("length").to_numpy()[order].reshape(-1, per)[:, 0].astype(np.int64)
            elites = list(table.column("bin").to_numpy()[order].reshape(-1, per).T)
        else:
            item, sizes, elites = item[order], table.column("length").to_numpy()[order].astype(np.int64), []
        rng = np.random.default_rng([SEED, migration, island, int(block) & 0x7FFFFFFF])
        lower = -(-int(sizes.sum()) // length)
        people = [np.ascontiguousarray(e) for e in elites] or [_new(sizes, length, rng, 0.0), _exact(sizes, length)]
        marks = [_fitness(sizes, p, length) for p in people]
        if -max(marks)[0] > lower and not migration:
            best = max(range(len(marks)), key=marks.__getitem__)
            people[best] = _mend(sizes, people[best], length, lower, rng)
            marks[best] = _fitness(sizes, people[best], length)
        if -max(marks)[0] > lower:  # else nothing can be better
            while len(people) < POPULATION:
                people.append(_new(sizes, length, rng, 0.05 * len(people)))
                marks.append(_fitness(sizes, people[-1], length))
            for _ in range(CHILDREN):
                a, b = rng.choice(len(people), 2, replace=False)
                child = _mend(sizes, _cross(sizes, people[a], people[b], length, rng), length, lower, rng)
                mark, worst = _fitness(sizes, child, length), min(range(len(marks)), key=marks.__getitem__)
                if mark > marks[worst]:
                    people[worst], marks[worst] = child, mark
                if -max(marks)[0] == lower:
                    break
        top = max(range(len(marks)), key=marks.__getitem__)
        n = len(item)
        return pa.table({"block": pa.array([block] * n, pa.int64()), "island": pa.array([island] * n, pa.int32()), "item": pa.array(item, pa.int64()), "length": pa.array(sizes, pa.int64()),
                         "bin": pa.array(people[top].astype(np.int64)), "bins": pa.array([-marks[top][0]] * n, pa.int64()), "fit": pa.array([marks[top][1]] * n, pa.float64())})
    return run


_RESULT = "block bigint, island int, item bigint, length bigint, bin bigint, bins bigint, fit double"


def _pack_blocks(items: DataFrame, length: int) -> DataFrame:
    """Best solution (block, item, length, bin) of each block of ``items`` (block, item, length)."""
    start = items.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    state = keep(start.groupBy("block", "island").applyInArrow(_evolve(length, 0), _RESULT), "islands")
    for migration in range(1, MIGRATIONS):
        own = state.withColumn("elite", F.lit(0))
        sent = state.withColumn("elite", F.lit(1)).withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))
        state = keep(own.union(sent).groupBy("block", "island").applyInArrow(_evolve(length, migration), _RESULT), "islands")
    best = state.groupBy("block").agg(F.max(F.struct(-F.col("bins"), "fit", "island")).alias("_best")).select("block", F.col("_best.island").alias("island"))
    return state.join(best, ["block", "island"]).select("block", "item", "length", "bin")


def pack(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pack items (item: a unique long, length: 1 to ``length``) into few sequences: adds sequence_id and offset.

    Only the lengths matter, so items are dealt to blocks of about BLOCK at random, whatever document they
    come from. Each block evolves on ISLANDS islands that exchange their elites; items as long as a sequence
    stand alone. Sequences that are not full are then opened and packed anew in fresh blocks, so
    that what each block leaves over is brought together. An empty table gives an empty one; columns other than item
    and length are not read.
    """
    alone = items.filter(F.col("length") >= length).select("item", "length", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_items, done = items.filter(F.col("length") < length).select("item", "length"), []
    n = open_items.count()
    for again in range(REPACKS):
        blocks = max(1, -(-n // BLOCK))
        dealt = open_items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(again)), F.lit(blocks)))
        packed = keep(_pack_blocks(dealt, length), "packed")
        fills = packed.groupBy("block", "bin").agg(F.sum("length").alias("_fill"), F.min("item").alias("_first"))
        placed = keep(packed.join(fills, ["block", "bin"]).select("item", "length", "_fill", F.col("_first").alias("sequence_id")), "filled")
        last = again == REPACKS - 1 or blocks == 1
        done.append(placed if last else placed.filter(F.col("_fill") >= length))
        if last:
            break
        open_items = placed.filter(F.col("_fill") < length).select("item", "length")
        n = open_items.count()
        if not n:
            break
    # A sequence is named by the smallest item in it.
    together = done[0]
    for part in done[1:]:
        together = together.union(part)
    before = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    return alone.union(together.select("item", "length", "sequence_id", offset.alias("offset")))


def pack_pieces(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` (with a column length, other columns kept) with sequence_id and offset.

    The pieces are kept once and numbered there; only numbers and lengths are packed.
    """
    rows = keep(pieces.withColumn("_item", F.monotonically_increasing_id()), "pieces")
    places = pack(rows.select(F.col("_item").alias("item"), "length"), length).select("item", "sequence_id", "offset")
    return rows.join(places, rows["_item"] == places["item"]).drop("_item", "item")
