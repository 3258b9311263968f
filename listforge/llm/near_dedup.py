"""Near duplicates by a chosen-path similarity join on word shingles."""

import hashlib
from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, CHUNK_BYTES, keep, narrow_batches, shingle_sets
from .components import components
from .exact_dedup import one_row_each

WORDS = 5
PERCENT = 85
#: Smallest shingle hashes kept per document; paths choose their tokens among them.
SKETCH = 32
#: Probability, at most, that sketches alone sort out a pair at the threshold.
MISSED = 1e-6
TREES = 6
#: Tokens chosen per level of a path, and the levels after which a node that stays large is compared in slices.
BRANCHES, LEVELS = 2, 8
#: Nodes of up to so many classes are compared without branching further.
LEAF = 2048
#: Share of a large node's classes from which a child counts as the same group again.
STAYS = 0.5
#: Rows, at most, of one side of a comparison of sketches, and rows and tokens of one of whole sets; a larger group is cut
#: into slices with common pivots.
NODE_ROWS, SLICE_ROWS, SLICE_TOKENS, PIVOTS = 8192, 2048, 1_000_000, 32
#: Rows and tokens, about, that one Python group holds.
GROUP_ROWS, GROUP_TOKENS = 8192, 1_000_000
#: Tokens of a group's tiles that are compared at once; a larger tile stands alone.
LOT_TOKENS = 250_000


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches of CHUNK_BYTES of text and 256 rows at most; a longer text stands alone. Sets are larger than their texts."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_BYTES, "right"))
            rows = max(1, min(256, upto - at))
            yield batch.slice(at, rows)
            at += rows


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            sets = shingle_sets(_texts(part.column("text")), size)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("mark"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([s[:SKETCH] for s in sets], pa.list_(pa.int64())),
            ], names=["doc_id", "mark", "n_shingles", "cls", "sketch"])
    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # a text that repeats brings its set once a task
        for part in _parts(batches):
            new = [i for i, c in enumerate(part.column("cls").to_pylist()) if c not in seen and not seen.add(c)]
            rows = part.take(pa.array(new, pa.int64()))
            sets = shingle_sets(_texts(rows.column("text")), size)
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in ("g", "cls", "slices")] + [pa.array(sets, pa.list_(pa.int64()))], names=["g", "cls", "slices", "tokens"])
    return run


def least_shared(percent: int) -> float:
    """Share of their sketches below which a pair at the threshold falls with a probability of at most MISSED.

    Each of the SKETCH smallest tokens of the union is in both sets with the probability of the threshold, and then stands
    in both sketches. So a pair shares at least a binomial number of tokens, however the sets' sizes differ.
    """
    p, below = percent / 100, 0.0
    for shared in range(SKETCH + 1):
        below += comb(SKETCH, shared) * p**shared * (1 - p) ** (SKETCH - shared)
        if below > MISSED:
            break
    return shared / SKETCH


# -- chosen paths --

def _children(rows: DataFrame) -> DataFrame:
    """Rows one level down: a child node is the hash of its parent and a chosen token that the path has not used."""
    left = F.array_except("sketch", "used") if "used" in rows.columns else F.col("sketch")
    chosen = F.slice(F.array_sort(F.transform(left, lambda t: F.struct(F.xxhash64(t, F.col("node")).alias("node"), t.alias("t")))), 1, BRANCHES)
    more = [c for c in ("used", "above") if c in rows.columns]
    return rows.select("cls", *more, F.explode(chosen).alias("c")).select("cls", "c.node", "c.t", *more)


def chosen_paths(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Members (g, cls) of all nodes with two classes or more that the trees end in.

    A path ends at a node of at most LEAF classes, at a larger one that has kept half of the node above, and after LEVELS
    tokens. So the number of levels follows the sizes: only large nodes whose classes differ branch again, while
    branching would copy a group of classes that are alike. Classes that run out of tokens are compared with those of nearly as few.
    """
    seeds = F.explode(F.array(*[F.lit(1000003 * (t + 1)).cast("long") for t in range(TREES)]))
    rows = classes.select("cls", "sketch", seeds.alias("node"))
    ended = []
    for level in range(1, LEVELS + 1):
        placed = keep(_children(rows), "paths")
        sizes = keep(placed.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "node-sizes")
        sized = keep(placed.join(sizes, "node"), "nodes")
        stop = F.col("n") <= LEAF
        if "above" in placed.columns:
            stop = stop | (F.col("n") >= F.col("above") * STAYS)
        if level == LEVELS or sizes.filter(F.col("n") > LEAF).isEmpty():
            ended.append(sized.select(F.col("node").alias("g"), "cls"))
            break
        ended.append(sized.filter(stop).select(F.col("node").alias("g"), "cls"))
        used = F.concat("used", F.array("t")) if "used" in sized.columns else F.array("t")
        rows = sized.filter(~stop).select("cls", "node", used.alias("used"), F.col("n").alias("above")).join(classes.select("cls", "sketch"), "cls")
        few = F.size("sketch") * percent <= 100 * (level + 1)
        ended.append(rows.filter(few).select(F.xxhash64("node", F.lit("few")).alias("g"), "cls"))
    out = ended[0]
    for part in ended[1:]:
        out = out.union(part)
    return out


# -- comparisons inside a group --

def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _shared(tile: np.ndarray, token: np.ndarray, row: np.ndarray, least: np.ndarray):
    """Postings of tokens that several rows of a tile share, rows that share too few left out: (row, first, last) of each posting list, and each row's lists."""
    salt = tile.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for _ in range(3):
        key = salt[row] ^ token.astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        common = np.empty(len(key), bool)
        common[order] = np.r_[False, same] | np.r_[same, False] if len(key) else False
        del key, order, same
        fine = common & (np.bincount(row[common], minlength=len(least)) >= least)[row]
        if fine.all():
            break
        token, row = token[fine], row[fine]
    if not len(row):
        return row, row, row, row
    key = salt[row] ^ token.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.r_[True, key[1:] != key[:-1]]
    number = np.empty(len(key), np.int32)
    number[order] = np.cumsum(first) - 1
    return row, number, row[order], np.r_[np.flatnonzero(first), len(key)]


def _lots(tile: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that are whole tiles of LOT_TOKENS together, one tile at least; ``ends``: tokens before each row, and all."""
    starts = np.r_[0, np.flatnonzero(np.diff(tile)) + 1, len(tile)]
    at = 0
    while at < len(starts) - 1 and len(tile):
        upto = max(at + 1, int(np.searchsorted(ends[starts], ends[starts[at]] + LOT_TOKENS, "right")) - 1)
        yield int(starts[at]), int(starts[upto])
        at = upto


def _linked(percent: int, exact: bool, first_pass: bool):
    """Compare the rows of each tile of an Arrow group (g, i, j, cls, tokens, and unless first_pass comp, left, right).

    With ``exact`` the tokens are whole sets and near ones are linked; else they are sketches, and alike ones are. Each row counts its
    common tokens with all others of its tile through the list of rows of each token. Puts out stars (root, member) in the first pass, else the links that connect something: never all pairs.
    """
    share = least_shared(percent)

    def run(table: pa.Table) -> pa.Table:
        tile = np.unique(np.stack([_ids(table.column("g")), table.column("i").to_numpy(), table.column("j").to_numpy()], 1), axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(tile, kind="stable")
        table, tile = table.take(pa.array(order)), tile[order]
        cls = table.column("cls").to_pylist()
        sets = table.column("tokens").combine_chunks()
        offsets, values = sets.offsets.to_numpy().astype(np.int64), sets.values.to_numpy(zero_copy_only=False)
        if first_pass:
            kind, left, right = np.arange(len(cls)), np.ones(len(cls), bool), np.ones(len(cls), bool)
        else:
            kind = _ids(table.column("comp"))
            left, right = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("left", "right"))
        a, b = [], []
        for lo, hi in _lots(tile, offsets):
            x, y = compared(tile[lo:hi], cls[lo:hi], offsets[lo : hi + 1], values, kind[lo:hi], left[lo:hi], right[lo:hi])
            a += x
            b += y
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    def compared(tile, cls, offsets, values, kind, left, right) -> tuple[list[bytes], list[bytes]]:
        n = len(cls)
        size = np.diff(offsets)
        # A set's smallest tokens are its sketch.
        short = size if exact else np.minimum(size, SKETCH)
        row = np.repeat(np.arange(n, dtype=np.int32), short)
        if (short == size).all():
            token = values[offsets[0] : offsets[-1]]
        else:
            token = values[np.repeat(offsets[:-1], short) + np.arange(len(row)) - np.repeat(np.cumsum(short) - short, short)]
        least = np.ceil(percent * size / 100) if exact else np.ceil(share * short - 1e-9)
        holder, number, posted, ends = _shared(tile, token, row, least)
        begin = np.searchsorted(holder, np.arange(n + 1))
        low, high = np.searchsorted(tile, tile, "left"), np.searchsorted(tile, tile, "right")
        a, b = [], []
        for u in np.flatnonzero(left & (begin[1:] > begin[:-1])).tolist():
            lo, hi = int(low[u]), int(high[u])
            if not (kind[lo:hi] != kind[u]).any():
                continue  # all of the tile is one component
            lists = number[begin[u] : begin[u + 1]]
            # Tokens in common with every row of the tile at once.
            counts = np.bincount(np.concatenate([posted[ends[k] : ends[k + 1]] for k in lists.tolist()]) - lo, minlength=hi - lo)
            if exact:
                fits = 100 * counts >= percent * (size[u] + size[lo:hi] - counts)
            else:
                fits = counts >= share * np.maximum(short[u], short[lo:hi]) - 1e-9
            for v in (np.flatnonzero(fits & right[lo:hi] & (kind[lo:hi] != kind[u])) + lo).tolist():
                if kind[v] != kind[u]:
                    kind[lo:hi][kind[lo:hi] == kind[v]] = kind[u]
                    if not first_pass:
                        a.append(cls[u])
                        b.append(cls[v])
        if first_pass:  # a star around the smallest class of each component
            for rows in np.split(np.arange(n), np.flatnonzero(np.diff(tile)) + 1):
                own: dict[int, list[bytes]] = {}
                for i, k in zip(rows.tolist(), kind[rows].tolist(), strict=True):
                    own.setdefault(k, []).append(cls[i])
                for members in own.values():
                    if len(members) > 1:
                        root = min(members)
                        a += [root] * len(members)
                        b += members
        return a, b
    return run


def _compared(wide: DataFrame, total: int, percent: int, exact: bool, first_pass: bool) -> DataFrame:
    """Kept links of tiles (g, i, j, cls, tokens, ...), several tiles to one Python group; ``total`` is the weight of all rows."""
    groups = max(1, ceil(total / (GROUP_TOKENS if exact else GROUP_ROWS)))
    dealt = wide.withColumn("_group", F.pmod(F.xxhash64("g", "i", "j"), F.lit(groups)))
    return keep(dealt.groupBy("_group").applyInArrow(_linked(percent, exact, first_pass), "a binary, b binary"), "links")


def _sized(rows: DataFrame, exact: bool) -> tuple[DataFrame, int, bool]:
    """Rows (g, cls, w: tokens, or 1 if not exact) of groups of two or more with n and slices, kept; all their weight; whether any has several slices."""
    most_rows, most_weight = (SLICE_ROWS, SLICE_TOKENS) if exact else (NODE_ROWS, NODE_ROWS)
    sizes = keep(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("all")).filter("n > 1")
                 .select("g", "n", F.ceil(F.greatest(F.col("n") / most_rows, F.col("all") / most_weight)).cast("long").alias("slices"), "all"), "group-sizes")
    total, most = sizes.agg(F.coalesce(F.sum("all"), F.lit(0)), F.coalesce(F.max("slices"), F.lit(0))).first()
    return keep(rows.join(sizes.drop("all"), "g"), "grouped"), total, most > 1


def _large_links(placed: DataFrame, payload: DataFrame, total: int, percent: int, exact: bool) -> DataFrame:
    """Links (a, b) inside the groups of several slices, of :func:`_sized` rows and the tokens by class.

    Each slice holds the same about PIVOTS members, which connect what is alike across slices. Then only rows outside the
    group's largest component are compared with all others. So a group's cost follows its rows where most of them connect.
    """
    most_rows, most_weight = (SLICE_ROWS, SLICE_TOKENS) if exact else (NODE_ROWS, NODE_ROWS)
    big = placed.filter("slices > 1").withColumn("own", F.pmod(F.xxhash64("cls", F.lit(3)), "slices"))
    pivot = F.pmod(F.xxhash64("cls", "g", F.lit(5)), "n") < PIVOTS
    to = F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).otherwise(F.array("own"))
    sliced = keep(big.select("g", F.explode(to).alias("i"), F.lit(0).cast("long").alias("j"), "cls"), "slices")
    found = _compared(sliced.join(payload, "cls"), total, percent, exact, True)
    comps = keep(components(found).select(F.col("node").alias("cls"), F.col("root").alias("comp")), "slice-components")
    # Written before it is counted and joined: a join of two scans splits a group with very many rows.
    known = keep(big.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "big-groups")
    parts = known.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("v"))
    open_groups = keep(parts.groupBy("g").agg(F.count(F.lit(1)).alias("comps"), F.sum("m").alias("m_all"), F.sum("v").alias("v_all"), F.max(F.struct("m", "comp", "v")).alias("top"))
                       .filter("comps > 1").select("g", F.col("top.comp").alias("main"), F.ceil(F.greatest(
                           (F.col("m_all") - F.col("top.m")) / most_rows, (F.col("v_all") - F.col("top.v")) / most_weight)).cast("long").alias("lots")), "open-groups")
    if open_groups.isEmpty():
        return found
    rest = known.join(open_groups, "g").withColumn("lot", F.pmod(F.xxhash64("cls", F.lit(7)), "lots"))
    zero = F.lit(0).cast("long")
    lefts = rest.filter("comp <> main").select("g", "lot", F.explode(F.sequence(zero, F.col("slices") - 1)).alias("own"), "cls", "comp", "w", F.lit(True).alias("left"), F.lit(False).alias("right"))
    rights = rest.select("g", F.explode(F.sequence(zero, F.col("lots") - 1)).alias("lot"), "own", "cls", "comp", "w", F.lit(False).alias("left"), F.lit(True).alias("right"))
    both = keep(lefts.union(rights).groupBy("g", F.col("lot").alias("i"), F.col("own").alias("j"), "cls", "comp", "w")
                .agg(F.max("left").alias("left"), F.max("right").alias("right")), "loose-tiles")
    weight = both.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    return found.union(_compared(both.drop("w").join(payload, "cls"), weight, percent, exact, False))


def links_in_groups(rows: DataFrame, payload: DataFrame, percent: int, exact: bool) -> tuple[DataFrame, DataFrame | None]:
    """Links (a, b) between the members of each group, of ``rows`` (g, cls, w: tokens, or 1 if not exact): stars of the components of
    groups that one task compares, and links of larger ones (None without any)."""
    placed, total, large = _sized(rows, exact)
    zero = F.lit(0).cast("long")
    small = _compared(placed.filter("slices = 1").select("g", zero.alias("i"), zero.alias("j"), "cls").join(payload, "cls"), total, percent, exact, True)
    return small, _large_links(placed, payload, total, percent, exact) if large else None


def _candidates(classes: DataFrame, percent: int) -> DataFrame:
    """Kept rows (cls, comp): classes that some path and alike sketches connect, by the smallest class they reach."""
    members = keep(chosen_paths(classes, percent).withColumn("w", F.lit(1).cast("long")), "members")
    # Within a node half of each hash tells tokens apart; an accident only makes one more candidate.
    sketches = classes.select("cls", F.transform("sketch", lambda t: t.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).alias("tokens"))
    small, large = links_in_groups(members, sketches, percent, exact=False)
    links = small if large is None else small.union(large)
    return keep(components(links).select(F.col("node").alias("cls"), F.col("root").alias("comp")), "candidates")


def _confirmed(groups: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Rows (cls, comp): classes that links of their whole sets connect, within the candidate groups (cls, comp).

    A class's set is worked out from one text, in the task that reads it, and moves once where one task compares its group.
    """
    rows = groups.join(classes.select("cls", "doc_id", "mark", "n_shingles"), "cls")
    placed, total, large = _sized(rows.select(F.col("comp").alias("g"), "cls", F.col("n_shingles").alias("w"), "doc_id", "mark"), True)
    asked = placed.select("g", "cls", "slices", F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    if placed.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    read = texts.withColumn("mark", F.xxhash64("text")).join(asked, texts["doc_id"].eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    sets = keep(read.select("g", "cls", "slices", "text").mapInArrow(_full_sets(size), "g binary, cls binary, slices bigint, tokens array<bigint>"), "sets")
    zero = F.lit(0).cast("long")
    stars = _compared(sets.filter("slices = 1").select("g", zero.alias("i"), zero.alias("j"), "cls", "tokens"), total, percent, True, True)
    found = stars.select(F.col("b").alias("cls"), F.col("a").alias("comp")).distinct()
    if large:
        payload = keep(sets.filter("slices > 1").select("cls", "tokens").dropDuplicates(["cls"]), "large-sets")
        links = _large_links(placed.select("g", "cls", "w", "n", "slices"), payload, total, percent, True)
        found = found.union(components(links).select(F.col("node").alias("cls"), F.col("root").alias("comp")))
    return keep(found, "components")


def near_dedup(docs: DataFrame, percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """One row per document: doc_id, mark, n_shingles, component_id, kept, cls (set id) and root (component's set id).

    Words are split at ASCII white space and A-Z lower-cased; a document's set has its distinct
    shingles of ``size`` words, or the whole sequence if it is shorter. Documents are linked
    when 100 * intersection >= percent * union of their full sets. component_id is the smallest
    doc_id reachable by links, kept is true where it is the document's own. Null and wordless
    texts have an empty set, no links and are kept; null ids lose to any id. Rows that repeat an id
    and text share all values. ``mark`` is the text's xxhash64, to tell apart texts under one id.

    Documents with equal sets form one class, so copies cost one row each. Classes follow TREES random
    trees: at each level a class enters the nodes of the tokens that are smallest under the node's
    hash, large nodes branch again, and the classes of a node are compared by their sketches. What
    alike sketches connect is one group, in which whole sets are compared and every link is confirmed. Paths miss
    most where one text contains the other; the README has the recall. A task's Python memory follows CHUNK_BYTES of text, one
    comparison of a tile, and the longest text, not the rows of a batch or a group.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    with narrow_batches(docs.sparkSession):
        sigs = keep(texts.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(
            _signatures(size), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark bigint, n_shingles bigint, cls binary, sketch array<bigint>"), "signatures")
        # One row per class: the smallest id and its text's mark; equal sets have equal sketches.
        classes = keep(sigs.filter("cls is not null").groupBy("cls").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("_rep"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"))
            .select("cls", "_rep.doc_id", "_rep.mark", "sketch", "n_shingles"), "classes")
        comps = _confirmed(_candidates(classes, percent), classes, texts, percent, size)

    reps = classes.select("cls", "doc_id")
    rooted = reps.join(comps, "cls").select("cls", "comp", "doc_id")
    least = keep(rooted.groupBy("comp").agg(F.min("doc_id").alias("_least")), "least")
    changed = keep(rooted.join(least, "comp").select("cls", F.col("comp").alias("root"), "_least"), "changed")
    named = reps.join(changed, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), F.coalesce("_least", "doc_id").alias("_least"))
    named = keep(named, "named")
    out = _with_class(sigs.drop("sketch"), named)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _with_class(rows: DataFrame, named: DataFrame) -> DataFrame:
    # Rows without a set get a key of their own, so that no task receives all of them.
    keyed = rows.withColumn("_key", F.coalesce("cls", F.unhex(F.hex("mark"))))
    named = named.withColumnRenamed("cls", "_key")
    return keyed.join(named, "_key", "left").select(
        "doc_id", "mark", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"), "cls", "root")


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest id; columns unchanged.

    Of rows that repeat an id and text one stays; texts without words are no copies of each other unless they repeat an id.
    """
    flags = keep(near_dedup(docs, percent).select("doc_id", "mark", "kept", "n_shingles", "component_id", "root"), "flags")
    # A group without any id keeps its smallest mark.
    nameless = flags.filter("component_id is null and n_shingles > 0").select(F.col("root").alias("_root"), "mark")
    first = nameless.groupBy("_root").agg(F.min("mark").alias("_first"))
    more = nameless.join(first, "_root").filter("mark <> _first").select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("_gone"), F.col("mark").alias("_mark"))
    gone = flags.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("mark").alias("_mark")).union(more).distinct()
    left = flags.filter(F.col("kept") & (F.col("doc_id").isNotNull() | (F.col("n_shingles") > 0))).groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    mark = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return one_row_each(docs, mark, keep(gone, "near-copies"), keep(left.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")), "repeated"))
