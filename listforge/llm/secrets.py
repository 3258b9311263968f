"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings. DataFrame functions only."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds, in their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
BASE_KINDS = ("assign", "access", "hex")

#: Kind: candidate pattern, alphabet that counts are kept for, bits that a window must reach.
CLASSES = {
    "hex_entropy": (r"(?<![A-Za-z0-9])[0-9A-Fa-f]{20,}(?![A-Za-z0-9])", "0123456789abcdefABCDEF", 3.2),
    "base64_entropy": (r"[A-Za-z0-9+/_=-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9),
}
WINDOW = 20
#: Matches of a text that are worked on together.
STEPS = 256
#: Candidates that any of these finds are no secrets, whatever their entropy.
ALLOW = (
    r"(?i)example|placeholder|changeme|dummy|sample|lorem|your[_-]|x{4,}|abcdefgh|01234567|12345678",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[A-Z]?[a-z]+([_/=+-][A-Z]?[a-z]+)*$",  # words
    r"^[A-Z]+([_/=+-][A-Z]+)*$",
    r"^[0-9=+/_-]+$",
)


def _found(text: Column, pattern: str, kind: str, order: int, values: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs (start, order, end, kind, string), in code points.

    Matches and the gaps between them alternate, so positions are sums of their lengths. ``values`` is
    the group whose length must be at least ``least``.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(whole.alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(values)).alias("v"), F.split(text, pattern, -1).alias("gap"))
    def one(at, p):
        begin = at + F.length(p["gap"])
        return F.struct(begin.alias("start"), F.lit(order).alias("order"), (begin + F.length(p["m"])).alias("end"), F.lit(kind).alias("kind"), p["m"].alias("string"), (F.length(p["v"]) >= least).alias("fine"))

    spans = _scanned(parts, F.lit(0), lambda at, p: at + F.length(p["gap"]) + F.coalesce(F.length(p["m"]), F.lit(0)), lambda at, more: at + more, one)
    found = F.transform(F.filter(spans, lambda x: x["fine"]), lambda x: x.dropFields("fine"))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,order:int,end:int,kind:string,string:string>>"))


def _scanned(values: Column, zero: Column, add, combine, emit) -> Column:
    """``emit(state before, value)`` of every value of an array, where ``add`` moves the state from value to value.

    The array is cut into blocks, whose own states (from ``zero``) ``combine`` to the state before each block. So no array
    grows beyond a block while it is built, and a text of very many matches costs about as many steps.
    """
    count = F.greatest(F.ceil(F.size(values) / STEPS).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(values, b * STEPS + 1, F.lit(STEPS)))
    totals = F.transform(blocks, lambda block: F.aggregate(block, zero, add))
    starts = F.aggregate(totals, F.array(zero), lambda acc, total: F.array_append(acc, combine(F.element_at(acc, -1), total)))

    def within(pair):
        def step(acc, value):
            return F.struct(add(acc["state"], value).alias("state"), F.array_append(acc["out"], emit(acc["state"], value)).alias("out"))
        first = F.get(pair["block"], F.lit(0))
        none = F.filter(F.array(emit(zero, first)), lambda _: F.lit(False))
        return F.aggregate(pair["block"], F.struct(pair["before"].alias("state"), none.alias("out")), step, lambda acc: acc["out"])

    paired = F.arrays_zip(blocks.alias("block"), F.slice(starts, F.lit(1), count).alias("before"))
    return F.flatten(F.transform(paired, within))


def _hot(string: Column, alphabet: str, bits: float) -> Column:
    """First and last position (from 1; null if none) in windows of ``string`` whose Shannon entropy reaches ``bits``.

    The state holds the count of each character in the window, as one letter each ("a" for 0), and the sum of c * log2(c): a
    step takes one character out and one in and changes their two letters, so it costs the same for any window length.
    """
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    at = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(alphabet), c))
    # Each step sees the character that enters and the one that leaves (0: none).
    leaving = F.concat(F.array_repeat(F.lit(0), WINDOW), at)
    steps = F.arrays_zip(at.alias("i"), F.slice(leaving, F.lit(1), F.length(string)).alias("o"), F.sequence(F.lit(1), F.length(string)).alias("n"))
    start = F.struct(F.lit("a" * len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def count(letters, i):
        return F.ascii(F.substring(letters, i, F.lit(1))) - ord("a")

    def put(letters, i, n):
        return F.overlay(letters, F.char(n + ord("a")), i, F.lit(1))

    def step(acc, s):
        out = count(acc["counts"], s["o"])
        less = F.when(s["o"] > 0, F.get(weight, out - 1) - F.get(weight, out)).otherwise(F.lit(0.0))
        left = F.when(s["o"] > 0, put(acc["counts"], s["o"], out - 1)).otherwise(acc["counts"])
        into = count(left, s["i"])
        total = acc["sum"] + less + F.get(weight, into + 1) - F.get(weight, into)
        hot = (s["n"] >= WINDOW) & (math.log2(WINDOW) - total / WINDOW >= bits - 1e-9)
        return F.struct(put(left, s["i"], into + 1).alias("counts"), total.alias("sum"),
                        F.when(hot & acc["first"].isNull(), s["n"] - WINDOW + 1).otherwise(acc["first"]).alias("first"),
                        F.when(hot, s["n"]).otherwise(acc["last"]).alias("last"))

    return F.aggregate(steps, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _marked(alphabet: str, bits: float):
    return lambda s: F.struct(s.alias("s"), _hot(s["string"], alphabet, bits).alias("h"))


def _allowed(allow: tuple[str, ...]):
    if not allow:
        return lambda s: F.lit(False)
    return lambda s: F.exists(F.array(*[F.lit(a) for a in allow]), lambda a: F.regexp_like(s["string"], a))


def scan(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """One row per document: doc_id, base and added, arrays of structs (start, order, end, kind, string).

    Positions count code points of the whole text, ends are exclusive. ``base`` has the matches of the
    fixed patterns, each kind leftmost and non-overlapping, by start and kind. ``added`` has, of the candidate strings of
    each character class, the stretch from the first to the last window with high entropy, unless
    the allow list knows the string or a base span overlaps. Null and empty texts have empty arrays. Rows
    are worked on alone: nothing is shuffled, repeated rows and ids repeat their result.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"], text.alias("_text"))
    t = F.col("_text")
    base = F.concat(_found(t, ASSIGN, "assign", 0, 2, 8), _found(t, ACCESS, "access", 1), _found(t, HEX, "hex", 2))
    rows = rows.withColumn("base", F.array_sort(base))
    known = _allowed(allow)
    for k, (kind, (pattern, _, _)) in enumerate(CLASSES.items()):
        rows = rows.withColumn(f"_c{k}", F.filter(_found(t, pattern, kind, len(BASE_KINDS) + k), lambda s: ~known(s)))
    rows = rows.drop("_text")
    added = []
    for k, (_, alphabet, bits) in enumerate(CLASSES.values()):
        rows = rows.withColumn(f"_h{k}", F.transform(f"_c{k}", _marked(alphabet, bits)))
        cut = F.transform(F.filter(f"_h{k}", lambda x: x["h"]["first"].isNotNull()), lambda x: F.struct(
            (x["s"]["start"] + x["h"]["first"] - 1).alias("start"), x["s"]["order"].alias("order"), (x["s"]["start"] + x["h"]["last"]).alias("end"), x["s"]["kind"].alias("kind"),
            F.substring(x["s"]["string"], x["h"]["first"], x["h"]["last"] - x["h"]["first"] + 1).alias("string")))
        added.append(cut)
    rows = rows.select("doc_id", "base", F.array_sort(F.concat(*added)).alias("_added"))
    return rows.select("doc_id", "base", F.when((F.size("base") > 0) & (F.size("_added") > 0), _free(F.col("base"), F.col("_added"))).otherwise(F.col("_added")).alias("added"))


def _free(base: Column, added: Column) -> Column:
    """Spans of ``added`` that overlap none of ``base``; both in order of their start.

    One pass over all spans in that order finds base spans that reach into a later added one, a pass from the end those
    that begin inside an earlier one.
    """
    def marked(spans, is_base):
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(is_base).alias("is_base"), s["end"].alias("end"), s.alias("span")))

    order = F.array_sort(F.concat(marked(base, True), marked(added, False)))
    reach = _scanned(order, F.lit(-1), lambda end, s: F.when(s["is_base"], F.greatest(end, s["end"])).otherwise(end), F.greatest,
                     lambda end, s: F.struct(s["start"].alias("start"), s["is_base"].alias("is_base"), s["end"].alias("end"), s["span"].alias("span"), (end <= s["start"]).alias("fine")))
    far = F.lit((1 << 31) - 1)
    clear = _scanned(F.reverse(reach), far, lambda begin, s: F.when(s["is_base"], F.least(begin, s["start"])).otherwise(begin), F.least,
                     lambda begin, s: F.struct(s["is_base"].alias("is_base"), s["span"].alias("span"), (s["fine"] & (begin >= s["end"])).alias("fine")))
    return F.transform(F.filter(F.reverse(clear), lambda s: ~s["is_base"] & s["fine"]), lambda s: s["span"])


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans by start and kind, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(kind: str):
    return lambda s: s["kind"] == kind
