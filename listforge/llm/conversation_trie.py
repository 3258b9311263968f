"""Prefix trie of conversations from double arrays.

Equal conversations become one path with a count. Paths, sorted, are cut into shards; each shard numbers its distinct turns densely,
packs its trie into BASE and CHECK arrays and walks every path through them. Only nodes on a shard's first or last path can
go on in a neighbour, so just these are merged across shards, and their subtrees are added up by pointer doubling.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import keep
from .common import BROADCAST_ROWS, WORD

#: Conversations that share one opening, and the most turns they can take from it.
FAMILY, OPENING = 20, 4
#: Bytes of a turn within a path: a hash of role and text, then the text's words.
HASH, TURN = 16, 20
#: Turns, about, that one shard's arrays hold.
SHARD = 1 << 17
#: Ids written as one block of a list of conversations that end at a node.
BLOCK = 100_000
#: Free slots that a node with several children tries before its children go to the end of the arrays.
TRIES = 48


def turn_key(role: Column, text: Column) -> Column:
    """Binary key of a turn; the length in front keeps role and text apart, null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(WORD)).cast("long")), 8, "0")
    return F.unhex(F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")), words))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Columns conv_id, path: each conversation's turns with the opening of its family, as turn keys one after another.

    One shuffle of turn keys brings a family of FAMILY ids together; texts stay where they are read.
    """
    conv = F.col("conv_id").cast("long")
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        (conv - conv % FAMILY).alias("family"), conv.alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), turn_key(F.col("role"), F.col("text")).alias("key")).alias("at"))
    own = (turns.repartition("family").groupBy("family", "conv_id").agg(F.array_sort(F.collect_list("at")).alias("at"))
           .select("family", "conv_id", F.transform("at", lambda t: F.hex(t["key"])).alias("own")))
    opening = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("own", 1, OPENING - 1))).over(Window.partitionBy("family"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENING).cast("int")
    none = F.array().cast("array<string>")
    return (own.withColumn("_head", F.coalesce(opening, none)).withColumn("_h", taken)
            .select("conv_id", F.unhex(F.array_join(F.concat(F.slice("_head", F.lit(1), F.col("_h")), F.slice("own", F.col("_h") + 1, F.size("own"))), "")).alias("path")))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) rows as texts of ids, at most BLOCK ids of one key each."""
    for batch in batches:
        keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
        out, first = [], 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or keys[i] != keys[first] or i - first == BLOCK:
                out.append((keys[first], ids[first], i - first, ",".join(map(str, ids[first:i]))))
                first = i
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                                             names=["key", "first_id", "n", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks as one row per key; a list of any length passes as a stream, never as a whole."""
    schema = pa.schema([("end_id", pa.int64()), ("n", pa.int64()), ("ends_sha256", pa.string())])
    key, least, n, digest, out = None, 0, 0, hashlib.sha256(), []
    for batch in batches:
        for block in batch.to_pylist():
            if block["key"] != key:
                if key is not None:
                    out.append({"end_id": least, "n": n, "ends_sha256": digest.hexdigest()})
                key, least, n, digest = block["key"], block["first_id"], 0, hashlib.sha256()
            digest.update((("," if n else "") + block["ids"]).encode())
            n += block["n"]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"end_id": least, "n": n, "ends_sha256": digest.hexdigest()}], schema)


def distinct_paths(paths: DataFrame) -> DataFrame:
    """Kept columns path, end_id (its smallest conversation), n, ends_sha256 for every different path.

    Paths are told apart by their hash, so a path that many conversations share moves 24 bytes for each. Its ids are sorted and written
    out by ranges over many tasks; only their finished text passes one task, since SHA-256 reads in order.
    """
    ids = paths.select(F.unhex(F.md5("path")).alias("key"), "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    blocks = ids.mapInArrow(_blocks, "key binary, first_id long, n long, ids string").repartition("key").sortWithinPartitions("key", "first_id")
    ends = blocks.mapInArrow(_digests, "end_id long, n long, ends_sha256 string")
    return keep(ends.join(paths, F.col("end_id") == F.col("conv_id")).select("path", "end_id", "n", "ends_sha256"), "paths")


class DoubleArray:
    """A trie in two arrays: the child of slot s over code c is slot BASE[s] + c if CHECK of that slot is s. Slot 0 is the root."""

    def __init__(self, size: int):
        self.base = np.zeros(size, np.int64)
        self.check = np.full(size, -1, np.int64)
        self.check[0] = 0
        self.free = 1  # no free slot lies before
        self.end = 1  # all slots from here on are free

    def _reserve(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, 2 * len(self.base)) - len(self.base)
            self.base = np.r_[self.base, np.zeros(more, np.int64)]
            self.check = np.r_[self.check, np.full(more, -1, np.int64)]

    def free_slots(self, n: int) -> np.ndarray:
        """The first ``n`` free slots."""
        self._reserve(self.end + n)
        found = np.flatnonzero(self.check[self.free : self.end] < 0)[:n] + self.free
        if len(found) < n:
            found = np.r_[found, np.arange(self.end, self.end + n - len(found))]
        return found

    def put(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Children for slots without any; (parent, code) in order of the parent."""
        start = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        count = np.diff(np.r_[start, len(parents)])
        single = start[count == 1]
        for i, n in zip(start[count > 1].tolist(), count[count > 1].tolist(), strict=True):
            self._family(int(parents[i]), codes[i : i + n])
        if len(single):
            slots = self.free_slots(len(single))
            self.base[parents[single]] = slots - codes[single]
            self._take(slots, parents[single])

    def _family(self, parent: int, codes: np.ndarray) -> None:
        least = int(codes.min())
        spread = codes - least
        last = int(spread.max())
        self._reserve(self.end + last + 1)
        for slot in self.free_slots(TRIES).tolist():
            self._reserve(slot + last + 1)
            if (self.check[slot + spread] < 0).all():
                break
        else:
            slot = self.end
        self._reserve(slot + last + 1)
        self.base[parent] = slot - least
        self._take(slot + spread, np.full(len(codes), parent))

    def _take(self, slots: np.ndarray, parents: np.ndarray) -> None:
        self.check[slots] = parents
        self.end = max(self.end, int(slots.max()) + 1)
        while self.free < self.end and self.check[self.free] >= 0:
            self.free += 1

    def step(self, slots: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Children of the slots over the codes, -1 where there is none."""
        to = self.base[slots] + codes
        inside = (to > 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == slots), to, -1)


def packed(paths: list[bytes]) -> tuple[DoubleArray, dict[bytes, int]]:
    """The trie of sorted distinct paths, and the dense number (from 1) of each turn."""
    length = np.array([len(p) // TURN for p in paths])
    numbers: dict[bytes, int] = {}
    trie = DoubleArray(int(length.sum()) + 2)
    at = np.zeros(len(paths), np.int64)
    for d in range(int(length.max(initial=0))):
        here = np.flatnonzero(length > d)
        codes = np.array([numbers.setdefault(paths[i][d * TURN : (d + 1) * TURN], len(numbers) + 1) for i in here.tolist()], np.int64)
        new = np.r_[True, (at[here][1:] != at[here][:-1]) | (codes[1:] != codes[:-1])]
        trie.put(at[here][new], codes[new])
        at[here] = trie.step(at[here], codes)
    return trie, numbers


_NODE = [("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
         ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("words", pa.int64()), ("ends_sha256", pa.string())]
_NODE_DDL = ", ".join(f"{name} {'binary' if t == pa.binary() else 'string' if t == pa.string() else 'long'}" for name, t in _NODE)


def _shard_nodes(paths: list[bytes], ends: list[int], counts: list[int], digests: list[str]) -> pa.RecordBatch:
    """Nodes of one shard. Nodes on the first or last path have a key and hold only what their own (keyless) children sum up to."""
    trie, numbers = packed(paths)
    size = trie.end
    length = np.array([len(p) // TURN for p in paths])
    ends_at, weight = np.array(ends, np.int64), np.array(counts, np.int64)
    least = np.full(size, np.iinfo(np.int64).max)
    n_convs, depth, words = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    digest: list[str | None] = [None] * size
    keys: list[bytes | None] = [None] * size
    at = np.zeros(len(paths), np.int64)
    here = np.arange(len(paths))
    d = 0
    while len(here):  # walk all paths down by one turn at a time
        slots = at[here]
        np.minimum.at(least, slots, ends_at[here])
        np.add.at(n_convs, slots, weight[here])
        depth[slots] = d
        for i in here[length[here] == d].tolist():
            digest[at[i]] = digests[i]
        here = here[length[here] > d]
        turns = [paths[i][d * TURN : (d + 1) * TURN] for i in here.tolist()]
        at[here] = trie.step(at[here], np.array([numbers[t] for t in turns], np.int64))
        words[at[here]] = [int.from_bytes(t[HASH:], "big") for t in turns]
        d += 1
    for path in (paths[0], paths[-1]):
        slot, key = 0, b""
        keys[0] = key
        for turn in (path[i : i + TURN] for i in range(0, len(path), TURN)):
            slot, key = int(trie.step(np.array([slot]), np.array([numbers[turn]]))[0]), hashlib.md5(key + turn).digest()
            keys[slot] = key
    shared = np.array([k is not None for k in keys])
    used = np.flatnonzero(trie.check[:size] >= 0)
    parent = trie.check[:size]
    own = ~shared
    children, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    below = used[own[used]]
    np.add.at(children, parent[below], 1)
    for slots in np.split(below[np.argsort(-depth[below], kind="stable")], np.flatnonzero(np.diff(np.sort(-depth[below]))) + 1):
        leaves[slots] += children[slots] == 0
        saved[slots] += (n_convs[slots] - 1) * words[slots]
        np.add.at(leaves, parent[slots], leaves[slots])
        np.add.at(saved, parent[slots], saved[slots])
    slots = used.tolist()
    root = used == 0
    above = shared[parent[used]]
    columns = [
        [keys[s] for s in slots], [keys[parent[s]] if shared[parent[s]] and s else None for s in slots],
        least[used], depth[used], pa.array(least[parent[used]], pa.int64(), mask=root | above), n_convs[used], children[used], leaves[used], saved[used], words[used],
        [digest[s] for s in slots]]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, _NODE, strict=True)], names=[n for n, _ in _NODE])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    turns = 0
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("path", "end_id", "n", "ends_sha256")], strict=True):
            rows.append(row)
            turns += len(row[0]) // TURN + 1
            if turns >= SHARD:
                yield _shard_nodes(*map(list, zip(*rows, strict=True)))
                rows, turns = [], 0
    if rows:
        yield _shard_nodes(*map(list, zip(*rows, strict=True)))


def _merged(nodes: DataFrame) -> DataFrame:
    """Shared nodes over all shards, with whole subtrees. Sums go up by doubling: round k adds what hangs 2**k nodes below."""
    parts = nodes.filter("key is not null").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("words").alias("words"), F.max("ends_sha256").alias("ends_sha256"))
    parts = keep(parts, "shared-nodes")
    children = parts.groupBy("parent_key").agg(F.count(F.lit(1)).alias("_more")).filter("parent_key is not null").withColumnRenamed("parent_key", "_of")
    parts = parts.join(children, F.col("key") == F.col("_of"), "left").withColumn("n_children", F.col("n_children") + F.coalesce("_more", F.lit(0)))
    whole = keep(parts.select(
        "key", "parent_key", "conv_id", "depth", "n_convs", "n_children", (F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved"), "ends_sha256", F.col("parent_key").alias("_up")), "subtrees-0")
    deepest = whole.agg(F.max("depth")).first()[0] or 0
    for k in range(int(deepest).bit_length()):
        below = whole.filter("_up is not null").groupBy(F.col("_up").alias("_to")).agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        over = whole.select(F.col("key").alias("_mid"), F.col("_up").alias("_next"))
        whole = keep(whole.join(below, F.col("key") == F.col("_to"), "left").join(over, F.col("_up") == F.col("_mid"), "left").select(
            "key", "parent_key", "conv_id", "depth", "n_convs", "n_children", (F.col("n_leaves") + F.coalesce("_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved"), "ends_sha256", F.col("_next").alias("_up")), f"subtrees-{k + 1}")
    return whole


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, turn, role, text): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by number, null first; turns with one number by the hash of role and text. A null role or text is empty, a row that
    repeats is a turn of its own, rows without a conv_id belong to no conversation. An empty table gives an empty result, a rebuilt
    conversation without turns ends at the root. One conversation's turns (20 bytes each, no texts) stand in one row, so it
    may have about 100 million. Columns with other names are not read.
    """
    paths = keep(rebuilt(conversations), "rebuilt")
    ranged = distinct_paths(paths).repartitionByRange("path").sortWithinPartitions("path")
    nodes = keep(ranged.mapInArrow(_shards, _NODE_DDL), "nodes")
    shared = _merged(nodes)
    above = shared.select(F.col("key").alias("_key"), F.col("conv_id").alias("_parent"))
    if above.count() <= BROADCAST_ROWS:
        above = F.broadcast(above)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
    rows = nodes.filter("key is null").select("parent_key", *columns).unionByName(shared.select("parent_key", F.lit(None).cast("long").alias("parent_conv_id"), *[c for c in columns if c != "parent_conv_id"]))
    nothing = hashlib.sha256().hexdigest()
    return rows.join(above, F.col("parent_key") == F.col("_key"), "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
