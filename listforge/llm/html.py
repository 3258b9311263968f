"""Main text of web pages: structure first, then text that a host's pages share, found by a suffix array."""

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _shingles, keep, mix

#: Elements that break the text into blocks.
BLOCKS = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                    "header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul").split())
#: Elements whose content is no main text.
OUT = frozenset("nav footer aside form script style noscript template iframe object embed canvas svg select textarea button input dialog menu head title".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is page furniture only outside an article: an article's own header has its headline.
OUTSIDE = frozenset(("header",))
MAIN = frozenset(("article", "main"))
#: Words of class, id and role that name furniture wherever they stand in a name, and those that do so as a name of their own.
CLEAR = frozenset(("ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comments commentlist consent cookie cookies disqus footer gdpr "
                   "masthead nav navbar navigation newsletter pagination popup promo promoted sidebar sidenav signup sponsor sponsored subscribe subscription toolbar topbar").split())
VAGUE = frozenset("comment menu modal notice notices related replies reply respond share sharing skip social toc widget".split())
#: First words of names that say what an element lacks or contains, not what it is.
STATES = frozenset("no not non without with has have is hide show".split())
#: Elements of running text, which longer names do not make furniture: "related-work" is a heading's anchor.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th pre blockquote figcaption caption a em strong b i span code sup sub".split())
#: Tags that a start tag closes if they are open, as browsers do.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: Shared words in a row that make boilerplate, if at least two pages hold them outside an article and this share of the host's pages anywhere.
SHARED, SHARE = 8, 0.04
#: Pages of a host that one suffix array takes, which does not change the result.
PAGES = 256
_SPACE = re.compile(r"\s+")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _judged(tag: str, attrs: list[tuple[str, str | None]]) -> str:
    """``out`` if names make the element furniture, ``doubt`` if they may, else nothing."""
    found = ""
    for key, value in attrs:
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return "out"
        if not value or key not in ("class", "id", "role", "aria-label"):
            continue
        for part in [value] if key == "aria-label" else value.split():
            # "ad-box" and "adBox" name an ad, "shadow" names nothing.
            words = [w.lower() for w in _NAMES.findall(part)]
            if not words:
                continue
            if part.lower() in CLEAR | VAGUE:
                if part.lower() in CLEAR or tag not in ("section", "article", "main", *PROSE) or tag in ("article", "li") and part.lower() in ("comment", "reply"):
                    return "out"
                found = found if tag in PROSE or tag in MAIN else "doubt"
            elif key != "aria-label" and tag not in PROSE and tag not in MAIN and words[0] not in STATES:
                ends = {words[0], words[-1]}
                if ends & CLEAR:
                    return "out"
                if ends & VAGUE:
                    found = "doubt"
    return found


class _Page(HTMLParser):
    """Blocks of a page as (place, text).

    Places: ``main``; ``inner``, an article inside something that only its name makes furniture; ``open`` outside all of
    these; ``doubt`` and ``main doubt``, where a name leaves it open; ``named`` and ``out``, furniture by name and by element.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.stack: list[tuple[str, str]] = []
        self.parts: list[str] = []
        self.place = "open"

    def _end_block(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.blocks.append((self.place, text))
            self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag in OUT or tag in MAIN:
            self._end_block()
        elif tag in ("br", "img"):
            self.parts.append(" ")
        if tag in VOID:
            return
        for name in CLOSES.get(tag, ()):
            # Only within the innermost container that can hold such items.
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == name:
                    self._close(k)
                    break
                if self.stack[k][0] in ("ul", "ol", "table", "div", "section", "article", "body", "td", "th", "dl", "blockquote"):
                    break
        self.stack.append((tag, self.place))
        self.place = self._place(tag, attrs)

    def _place(self, tag, attrs) -> str:
        place = self.place
        if place == "out" or tag in OUT:
            return "out"
        # What encloses the whole page names nothing.
        verdict = "" if tag in ("html", "body", "main") else _judged(tag, attrs)
        if verdict == "out":
            return place if place == "named" else "named"
        whole = tag in MAIN or ("role", "main") in attrs or ("itemprop", "articleBody") in attrs
        if place == "named":
            return "inner" if tag in MAIN else place
        if tag in OUTSIDE and place in ("open", "doubt"):
            return "out"
        if verdict == "doubt":
            return "main doubt" if place in ("main", "inner", "main doubt") else "doubt"
        return "main" if whole and place in ("open", "doubt") else place

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def _close(self, k: int) -> None:
        self._end_block()
        self.place = self.stack[k][1]
        del self.stack[k:]

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                if any(t in BLOCKS or t in OUT or t in MAIN for t, _ in self.stack[k:]):
                    self._close(k)
                else:  # an inline element does not break its block
                    self.place = self.stack[k][1]
                    del self.stack[k:]
                return
            if self.stack[k][0] in MAIN and tag not in MAIN and tag not in ("body", "html"):
                return  # a stray end tag does not leave the article

    def handle_data(self, data):
        self.parts.append(data)

    def read(self, html: str) -> list[tuple[str, str]]:
        self.feed(html)
        self.close()
        self._end_block()
        return self.blocks


def page_blocks(html: str | None) -> list[tuple[str, str]]:
    return _Page().read(html) if html else []


#: Kinds of blocks: text of an article, a block that goes if other pages hold all of it, a block that loses what they hold.
FIXED, DOUBT, OPEN = 0, 1, 2
_BLOCKS = pa.list_(pa.struct([("kind", pa.int32()), ("text", pa.string())]))
_BLOCKS_DDL = "array<struct<kind:int,text:string>>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            blocks, around, loose, content = [], [], [], []
            for html in part.column("html").to_pylist():
                found = page_blocks(html)
                places = {place for place, _ in found}
                fixed, other = (("main",), ("main doubt",)) if "main" in places else (("inner",), ("main doubt",)) if "inner" in places else ((), ("open", "doubt", "main doubt"))
                own = [(FIXED if p in fixed else OPEN if p == "open" else DOUBT, t) for p, t in found if p in fixed or p in other]
                blocks.append([{"kind": kind, "text": t} for kind, t in own])
                around.append([t for p, t in found if p not in fixed and p not in other])
                loose.append(any(kind for kind, _ in own))
                content.append(hashlib.blake2b(repr((own, around[-1])).encode("utf-8", "surrogatepass"), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("host"), pa.array(blocks, _BLOCKS),
                                              pa.array(around, pa.list_(pa.string())), pa.array(loose, pa.bool_()), pa.array(content, pa.binary())],
                                             names=["page_id", "url", "host", "blocks", "around", "loose", "content"])


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in sorted order, by doubling the compared length; only suffixes that are still equal are sorted again."""
    n, width = len(tokens), 1
    order = np.argsort(tokens, kind="stable")
    at, rank = np.arange(n), np.empty(n, np.int64)  # places in the order that are open, and each suffix's first place of its equals
    new = np.r_[True, tokens[order[1:]] != tokens[order[:-1]]][:n]
    while True:
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(at)])
        rank[order[at]] = np.repeat(at[first], size)
        at = at[np.repeat(size > 1, size)]
        if not len(at):
            return order
        suffix = order[at]
        after = np.where(suffix + width < n, rank[np.minimum(suffix + width, n - 1)], -1)
        key = rank[suffix] * (n + 1) + after
        by_key = np.argsort(key, kind="stable")
        order[at], key = suffix[by_key], key[by_key]
        new = np.r_[True, key[1:] != key[:-1]]
        width *= 2


def common_prefixes(tokens: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length, up to ``most``, of what each suffix shares with the one before it in the order."""
    n = len(tokens)
    same, length = np.arange(max(0, n - 1)), np.zeros(n, np.int64)
    for k in range(most):
        a, b = order[same] + k, order[same + 1] + k
        inside = (a < n) & (b < n)
        same = same[inside][tokens[a[inside]] == tokens[b[inside]]]
        length[same + 1] += 1
    return length


def _words(row: dict) -> list[str]:
    """The words of a page outside its article: those of its unsettled blocks, then of its furniture."""
    return [w for block in row["blocks"] if block["kind"] != FIXED for w in block["text"].split(" ")] + [w for block in row["around"] for w in block.split(" ")]


def _windows(words: list[str], known: dict[str, int]) -> np.ndarray:
    """A hash (int64) for each run of SHARED words of a page, in order."""
    if len(words) < SHARED:
        return np.empty(0, np.int64)
    hashes = [known[w] if w in known else known.setdefault(w, int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")) for w in words]
    return _shingles(np.array(hashes, np.uint64), SHARED).view(np.int64)


#: Characters of streams that a task holds before it packs them.
PACKED = 8_000_000
_CODEC = "zstd"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pages of a task by part: their words outside the article and in it, compressed."""
    def pack() -> pa.RecordBatch:
        texts = [json.dumps(pages).encode() for pages in held.values()]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), pa.array([k[2] for k in held], pa.int64()),
                                           pa.array(map(len, texts), pa.int64()), pa.array([pa.compress(t, codec=_CODEC, asbytes=True) for t in texts], pa.binary())],
                                          names=["_part", "host", "n", "size", "pages"])

    seen, held, size = set(), {}, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for row in batch.slice(at, 256).to_pylist():
                if (row["_part"], row["content"]) in seen:
                    continue
                seen.add((row["_part"], row["content"]))
                outside = " ".join([b["text"] for b in row["blocks"] if b["kind"] != FIXED] + row["around"])
                inside = " ".join(b["text"] for b in row["blocks"] if b["kind"] == FIXED)
                held.setdefault((row["_part"], row["host"], row["n"]), []).append((row["content"].hex(), outside, inside))
                size += len(outside) + len(inside)
            if size > PACKED:
                yield pack()
                held, size = {}, 0
    if held:
        yield pack()


def _streams(table: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The pages of a part as one stream: its distinct words, and for each place the word's number, the page and whether it is outside the article.

    A page has its words outside the article, an end mark, those of the article and another one, so no run crosses these.
    """
    pages = {}
    for size, packed in zip(table.column("size").to_pylist(), table.column("pages").to_pylist(), strict=True):
        for content, *texts in json.loads(pa.decompress(packed, decompressed_size=size, codec=_CODEC, asbytes=True)):
            pages[content] = texts  # tasks may have met the same page
    numbers: dict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    tokens, lengths = [], []
    for texts in pages.values():
        for text in texts:
            words = text.split(" ") if text else []
            tokens.extend(map(numbers.__getitem__, words))
            tokens.append(-1 - len(lengths))
            lengths.append(len(words) + 1)
    segment = np.repeat(np.arange(len(lengths)), lengths)
    return list(numbers), np.array(tokens, np.int64), segment // 2, segment % 2 == 0


def _held_by(group: np.ndarray, page: np.ndarray, outside: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` groups of places the pages that hold it, and those that hold it outside an article."""
    most = int(page.max(initial=0)) + 1
    count = lambda some: np.bincount(np.unique(group[some] * most + page[some]) // most, minlength=n)
    return count(slice(None)), count(outside)


def _part_runs(table: pa.Table) -> pa.Table:
    """Runs of SHARED words that may be boilerplate of the host: what SHARE of its pages hold, SHARE of some part's pages hold."""
    words, tokens, page, outside = _streams(table)
    order = suffix_array(tokens)
    group = np.cumsum(common_prefixes(tokens, order, SHARED) < SHARED) - 1
    # A run starts where SHARED more words come before an end mark.
    marks = np.flatnonzero(tokens < 0)
    left = marks[np.searchsorted(marks, np.arange(len(tokens)))] - np.arange(len(tokens))
    starts = left[order] >= SHARED
    at, group = order[starts], group[starts]
    new = np.r_[True, group[1:] != group[:-1]][: len(group)]
    first = np.flatnonzero(new)
    pages, out = _held_by(np.cumsum(new) - 1, page[at], outside[at], len(first))
    n, host = table.column("n")[0].as_py(), table.column("host")[0].as_py()
    own = page[-1] + 1
    may = pages >= SHARE * own - 1e-9
    if own == n:  # the whole host
        may &= out > 1
    texts = [" ".join(words[t] for t in tokens[k : k + SHARED]) for k in at[first[may]]]
    known: dict[str, int] = {}
    return pa.table({"host": pa.array([host] * len(texts), pa.string()), "run": pa.array([int(_windows(t.split(" "), known)[0]) for t in texts], pa.int64()), "words": pa.array(texts, pa.string())})


def _part_counts(table: pa.Table, asked: pa.Table) -> pa.Table:
    """Pages of a part that hold the runs asked for, and those that hold them outside an article."""
    if not table.num_rows or not asked.num_rows:
        return pa.table({"host": pa.array([], pa.string()), **{c: pa.array([], pa.int64()) for c in ("run", "pages", "out")}})
    words, tokens, page, outside = _streams(table)
    numbers = {w: k for k, w in enumerate(words)}
    # Windows are compared by a hash of their words' numbers here; end marks are numbers of their own.
    windows = lambda t: _shingles(mix(t.astype(np.uint64)), SHARED)
    found = [[numbers.get(w, -1) for w in text.split(" ")] for text in asked.column("words").to_pylist()]
    here = np.array([min(f) >= 0 for f in found])
    runs = np.array(asked.column("run").to_pylist(), np.int64)[here]
    wanted = np.concatenate([windows(np.array(f, np.int64)) for f, h in zip(found, here, strict=True) if h] or [np.empty(0, np.uint64)])
    keys, first = np.unique(wanted, return_index=True)
    held = windows(tokens) if len(tokens) >= SHARED else np.empty(0, np.uint64)
    place = np.searchsorted(keys, held)
    at = np.flatnonzero(keys[np.minimum(place, len(keys) - 1)] == held) if len(keys) else np.empty(0, np.int64)
    pages, out = _held_by(place[at], page[at], outside[at], len(keys))
    return pa.table({"host": pa.array([table.column("host")[0].as_py()] * len(keys), pa.string()), "run": pa.array(runs[first], pa.int64()), "pages": pa.array(pages, pa.int64()), "out": pa.array(out, pa.int64())})


def _page_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[str, int] = {}
        for row in batch.to_pylist():
            runs = np.unique(_windows(_words(row), known))
            yield pa.RecordBatch.from_arrays([pa.array([row["item"]] * len(runs), pa.int64()), pa.array([row["host"]] * len(runs), pa.string()), pa.array(runs, pa.int64())],
                                             names=["item", "host", "run"])


def _unique_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of unsettled pages without the runs that distinct pages of the host share."""
    for batch in batches:
        known: dict[str, int] = {}
        texts = []
        for row in batch.to_pylist():
            words = _words(row)
            runs = _windows(words, known)
            start = np.flatnonzero(np.isin(runs, np.array(row["runs"] or [], np.int64)))
            covered = np.zeros(len(words), bool)
            for k in range(SHARED):
                covered[start + k] = True
            left, at = [], 0
            for block in row["blocks"]:
                if block["kind"] == FIXED:
                    left.append(block["text"])
                    continue
                own = block["text"].split(" ")
                part = covered[at : at + len(own)]
                at += len(own)
                stays = _own_words(part) if block["kind"] == OPEN else np.full(len(own), not part.all())
                if stays.any():
                    left.append(" ".join(w for w, s in zip(own, stays, strict=True) if s))
            texts.append("\n".join(left))
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("content"), pa.array(texts, pa.string())], names=["host", "content", "rest"])


def _own_words(covered: np.ndarray) -> np.ndarray:
    """Words of a block that stay: a run that reaches in from a neighbouring block counts only if it takes the whole block."""
    if covered.all():
        return ~covered
    edges = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
    own = np.ones(len(covered), bool)
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        own[a:b] = b - a < SHARED
    return own


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text.

    Scripts, styles, forms, menus, headers, footers, asides, adverts, notices and reader comments go by their elements and by
    names in class, id and role. If a page has an article or main element, the rest of that is its text, whatever other pages
    repeat of it. Two kinds of blocks are unsettled: those outside such elements on a page that has none, and those with a name
    that may mean furniture ("related-links", a section called "notice"), on any page. Every distinct page of every host is dealt
    to one of the host's parts of about PAGES with all its words, and a suffix array finds the part's runs of SHARED words.
    Runs that SHARE of a part's pages hold are counted over the whole host. What two pages hold outside
    their articles and SHARE of the host's pages hold anywhere
    is boilerplate: it leaves the first kind of block, and a block of the second kind goes if such runs cover it, else it
    stays whole. Pages with equal blocks are one page here. Text is whole: character references are
    decoded, white space in a block is one space, blocks are joined by line breaks. Null and empty pages
    give an empty text; repeated pages are pages of their own, null urls make one host. An empty table gives an empty one; other
    columns are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))
    kinds = {n: pages.schema[n].dataType.simpleString() for n in ("page_id", "url")}
    parsed = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(
        _parsed, f"page_id {kinds['page_id']}, url {kinds['url']}, host string, blocks {_BLOCKS_DDL}, around array<string>, loose boolean, content binary")
    rows = keep(parsed.withColumn("item", F.monotonically_increasing_id()), "parsed", compression="zstd")
    # Kept before joins, here and below, so that a join may split a host or a run with very many rows.
    contents = keep(rows.groupBy("host", "content").agg(F.min("item").alias("item"), F.max("loose").alias("_some")), "contents")
    hosts = keep(contents.groupBy("host").agg(F.count(F.lit(1)).alias("n")).withColumn("_parts", F.ceil(F.col("n") / PAGES).cast("long")), "hosts")
    # One key for host and part: with two, rows dealt out by the host alone would do for Spark.
    key = lambda part: F.concat_ws(" ", part.cast("string"), "host").alias("_part")
    streams = (rows.join(hosts, "host").select(key(F.pmod(F.xxhash64("content"), "_parts")), "host", "n", "content", "blocks", "around")
               .mapInArrow(_packed, "_part string, host string, n bigint, size bigint, pages binary").groupBy("_part"))
    found = streams.applyInArrow(_part_runs, "host string, run bigint, words string").groupBy("host", "run").agg(F.min("words").alias("words"))
    asked = found.join(hosts, "host").withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).select(key(F.col("_p")), "run", "words")
    # The parts are dealt out once for both steps: Spark reuses the exchange.
    counts = streams.cogroup(asked.groupBy("_part")).applyInArrow(_part_counts, "host string, run bigint, pages bigint, out bigint")
    counted = keep(counts.groupBy("host", "run").agg(F.sum("pages").alias("_pages"), F.sum("out").alias("_out")).filter("_out > 1"), "counted-runs")
    shared = keep(counted.join(hosts, "host").filter(F.col("_pages") >= SHARE * F.col("n")).select("host", "run"), "shared-runs")
    loose = keep(rows.filter("loose").select("item", "blocks", "around").join(contents.filter("_some"), "item"), "unsettled")
    held = keep(loose.select("item", "host", "blocks", "around").mapInArrow(_page_runs, "item bigint, host string, run bigint"), "page-runs")
    gone = held.join(shared, ["host", "run"]).groupBy("item").agg(F.collect_list("run").alias("runs"))
    rest = keep(loose.join(gone, "item", "left").select("host", "content", "blocks", "around", "runs")
                .mapInArrow(_unique_text, "host string, content binary, rest string"), "unique-runs")
    settled = rows.filter("not loose").select("page_id", "url", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n").alias("text"))
    return settled.union(rows.filter("loose").join(rest, ["host", "content"], "left").select("page_id", "url", F.coalesce("rest", F.lit("")).alias("text")))
