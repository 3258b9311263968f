"""Secret scans against brute force over the regexes and windows; pages by worked examples."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from listforge.llm import html, secrets

ASSIGN = re.compile(secrets.ASSIGN, re.A)
AWS = "AKIA" + "ABCDEFGHIJ234567"
NOISE = "q7Zt9Lw2XkP4vRb8NcJ6hYd3"


def brute(text):
    base = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    added = []
    for k, (kind, (pattern, _, bits)) in enumerate(secrets.CLASSES.items()):
        for m in re.finditer(pattern, text):
            if any(re.search(a, m[0]) for a in secrets.ALLOW):
                continue
            hot = [i for i in range(len(m[0]) - 19) if -sum(c / 20 * math.log2(c / 20) for c in Counter(m[0][i : i + 20]).values()) >= bits - 1e-9]
            if hot:
                s = (m.start() + hot[0], 3 + k, m.start() + hot[-1] + 20, kind)
                if not any(b[0] < s[2] and s[0] < b[2] for b in base):
                    added.append(s)
    return sorted(base), sorted(added)


TEXTS = [
    "", None, "nothing here", f"password = \"hunter2hunter2\" and TOKEN:{NOISE}", "secret=token:abcdefghij", "api_key='short'", f"é😀 key {AWS} {AWS}x AKIA123",
    "0123456789abcdef" * 2, "ABCDEF0123456789" * 3, f"see {NOISE} and {NOISE}=={NOISE}", "example_" + NOISE, "thisisaverylongwordwithoutanynoise", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "c0ffee" * 4, "3f2a9c81e7b64d05c3f2a9c8", "123e4567-e89b-42d3-a456-426614174000", "http://host/some/path/with/words/only", "deadbeef" * 5, "Api-Key:  x" + NOISE, "passwd\"=\"" + "a" * 8,
    "x" * 50_000 + NOISE, NOISE * 300,
]


def test_scan(make):
    rng = random.Random(4)
    alphabet = "abcdef0123456789ABCxyz+/=_- "
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(300)) for _ in range(40)]
    for r in secrets.scan(make(*enumerate(texts))).collect():
        base, added = brute(texts[r.doc_id] or "")
        assert [(s.start, s.order, s.end, s.kind) for s in r.base] == base, r.doc_id
        assert [(s.start, s.order, s.end, s.kind) for s in r.added] == added, r.doc_id
        assert all(s.string == (texts[r.doc_id] or "")[s.start : s.end] for s in [*r.base, *r.added])


def test_scan_odd_rows(odd, clashing):
    for docs in (odd, clashing):
        rows = secrets.scan(docs).collect()
        assert len(rows) == odd.count() and not any(r.base or r.added for r in rows)
    assert secrets.scan(odd.limit(0)).count() == 0
    assert secrets.scan(odd, allow=()).count() == odd.count()


def test_very_many_secrets_in_one_text(make):
    n = 16_000
    hex_ = "0123456789abcdef" * 2
    text = " ".join(f"token={k:08d}xyz {hex_}" for k in range(n // 2))
    start = time.time()
    row = secrets.scan(make((1, text))).selectExpr("size(base) as n", "base[0] as first", f"base[{n - 1}] as last", "size(added) as added").first()
    assert time.time() - start < 20
    assert row.n == n and (row.first.start, row.first.end) == (0, 17) and row.last.end == len(text) and text[row.last.start : row.last.end] == hex_


def test_spans_that_overlap_base_spans_are_found_in_any_order(make):
    rng = random.Random(5)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(44))
    texts = [f"{key} token={key} x", f"token={key} {key}", f"{key[:30]} AKIA{key[:16].upper()} {key[3:33]}", " ".join(f"token={key} {key[::-1]}" for _ in range(300))]
    got = {r.doc_id: r for r in secrets.scan(make(*enumerate(texts))).collect()}
    for i in got:
        spans = [(s.start, s.end) for s in got[i].added]
        base = [(s.start, s.end) for s in got[i].base]
        assert spans == sorted(spans) and not any(a < d and c < b for a, b in spans for c, d in base)
    assert len(got[0].added) == len(got[1].added) == 1 and len(got[3].added) == 300


def test_scan_is_native(make):
    plan = secrets.scan(make((1, "a")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def main(page):
    return "\n".join(t for p, t in html.page_blocks(page) if p == "main")


@pytest.mark.parametrize("page,text", [
    ("<html><head><title>T</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one <b>two</b>\n three<p>four<br>five</article><footer>f</footer></body></html>", "A & B\none two three\nfour five"),
    ("<article><script>var a='</p>'</script><div class='ad-box'>buy</div><p>text</p><section class=\"comments\"><p>nice</p></section><aside>x</aside>tail</article>", "text\ntail"),
    ("<main><p>1</p><form><input value=x><p>mail</p></form><p>2</main>after", "1\n2"),
    ("<article><header><h1>Head</h1></header><p>a &lt;b&gt; &copy; &#233;&am</p></article>", "Head\na <b> © é&am"),
    ("<article><p>one</div></p><ul><li>a<li>b</ul><table><tr><td>x<td>y</table></article>", "one\na\nb\nx\ny"),
    ("<article class='post shadow'><p>kept</p><!-- no --><style>p{}</style><p></p></article><article class='comment'>gone</article>", "kept"),
    ("<div id=cookie-notice><article>no</article></div><article>yes", "yes"),
])
def test_page(page, text):
    assert main(page) == text


def test_suffix_array():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 300):
        tokens = rng.integers(0, 4, n)
        order = html.suffix_array(tokens)
        suffixes = [tuple(tokens[i:]) for i in range(n)]
        assert order.tolist() == sorted(range(n), key=suffixes.__getitem__)
        common = html.common_prefixes(tokens, order, 5)
        for k in range(1, n):
            a, b = suffixes[order[k - 1]], suffixes[order[k]]
            assert common[k] == next((i for i in range(5) if a[i : i + 1] != b[i : i + 1] or not a[i : i + 1]), 5)


@pytest.mark.parametrize("page,text", [
    ('<div class="content no-sidebar"><article><p>kept</p></article></div>', "kept"),
    ('<article class="post has-comments"><p>kept</p></article>', "kept"),
    ('<article><h2 id="related-work">Related work</h2><p id="notice-of-appeal">was filed</p><section aria-label="Social history"><p>long</p></section><p>x <math><mi>y</mi></math> z</p></article>',
     "Related work\nwas filed\nlong\nx y z"),
    ('<div class="layout-sidebar"><article>only one</article></div>', "only one"),
    ('<div class="sidebar"><article>teaser</article></div><main><p>text</p></main>', "text"),
    ('<article><p>text</p><div class="comments"><article class="comment">gone</article></div><div class="ad">buy</div><ul class="nav-list"><li>a</li></ul></article>', "text"),
])
def test_names_on_one_page(spark, page, text):
    rows = spark.createDataFrame([(1, "http://a/", page)], "page_id long, url string, html string")
    assert html.extract(rows).first().text == text


def test_doubtful_names_are_settled_by_the_host(spark):
    """What a vague name marks goes if other pages repeat it and stays if it is the page's own."""
    again = "read our other stories about this and many more things"
    rows = [(i, f"http://h/{i}", f"<article><p>Text {i}</p><div class='related-links'>{again}</div><section id=notice><p>Own notice of page {i}: court {i * 3} sits at noon on day {i}</p></section></article>") for i in range(6)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Text {i}\nOwn notice of page {i}: court {i * 3} sits at noon on day {i}" for i in range(6)}


def brute_host(pages, share):
    """Texts of article-less pages: words of runs of SHARED that enough distinct pages hold go, run by run over all pages."""
    n, words = html.SHARED, [[w for b in blocks for w in b.split(" ")] for blocks in pages]
    different = {repr(blocks): set(zip(*[w[k:] for k in range(n)])) for blocks, w in zip(pages, words)}
    counts = Counter(run for runs in different.values() for run in runs)
    out = []
    for blocks, w in zip(pages, words):
        covered = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            k = counts[tuple(w[i : i + n])]
            if k > 1 and k >= share * len(different):
                covered[i : i + n] = True
        at, left = 0, []
        for b in blocks:
            own = b.split(" ")
            stays = html._own_words(covered[at : at + len(own)])
            at += len(own)
            if stays.any():
                left.append(" ".join(x for x, s in zip(own, stays) if s))
        out.append("\n".join(left))
    return out


@pytest.mark.parametrize("pages", [3, 256])
def test_hosts_against_brute_force(spark, monkeypatch, pages):
    monkeypatch.setattr(html, "PAGES", pages)
    rng = random.Random(21)
    common = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(6, 20))) for _ in range(8)]
    hosts = {}
    for i in range(120):
        blocks = [rng.choice(common) if rng.random() < 0.4 else " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 6))]
        hosts.setdefault(f"h{i % 2}", []).append((i, blocks))
    for _, own in hosts.items():
        own.append((1000 + own[0][0], own[0][1]))  # a page that comes twice
    rows = [(i, f"http://{h}/{i}", "".join(f"<p>{b}</p>" for b in blocks)) for h, own in hosts.items() for i, blocks in own]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for own in hosts.values():
        assert [got[i] for i, _ in own] == brute_host([b for _, b in own], html.SHARE)


def test_a_passage_on_two_of_many_pages_is_a_quotation(spark):
    quote = "to be or not to be that is the question we ask"
    rows = [(i, f"http://h/{i}", f"<p>Own {' '.join(f'p{i}x{k}' for k in range(10))}</p>" + f"<p>{quote}</p>" * (i in (3, 31))) for i in range(60)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].endswith(quote) and got[31].endswith(quote)


def test_extract(spark):
    notice = "we value your trust and sell all of your data to our many partners"
    rows = [(i, f"http://h.example/{i}", f"<body><div>{notice}</div><div>Own words of page {i} and more {i * 7}</div><p>{notice} plus {i}</p></body>") for i in range(5)]
    rows += [(7, "http://h.example/7", "<nav>x</nav><article><p>whole</p></article>"), (8, None, None), (9, "", ""), (10, "http://other.example/", f"<div>{notice}</div>"), (7, "http://h.example/7", "<p>again</p>")]
    got = sorted((r.page_id, r.text) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == sorted([(i, f"Own words of page {i} and more {i * 7}\n{i}") for i in range(5)] + [(7, "whole"), (7, "again"), (8, ""), (9, ""), (10, notice)])


def test_extract_clash(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "http://a/", "<article>t</article>"), (None, None, "<p>" + "long words " * 50_000)], "page_id long, url string, html string")
    for name in ("host", "item", "text", "settled", "rest"):
        rows = rows.withColumn(name, F.lit("clash"))
    assert sorted(len(r.text) for r in html.extract(rows).collect()) == [1, 11 * 50_000 - 1]
    assert html.extract(rows.limit(0)).count() == 0


@pytest.mark.parametrize("pages", [2, 256])
def test_runs_of_the_whole_host(spark, monkeypatch, pages):
    """A notice on two of many pages goes however the host is dealt out, and copies of a page do not empty each other."""
    monkeypatch.setattr(html, "PAGES", pages)
    notice = "we value your trust and sell all of your data to our many partners"
    rows = [(i, f"http://h/{i}", f"<div>Own words of page {i} and {' '.join(f'p{i}x{k}' for k in range(12))}</div>" + f"<p>{notice}</p>" * (i in (3, 31))) for i in range(40)]
    rows += [(100 + k, f"http://h/copy{k}", rows[5][2]) for k in range(3)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own words of page {5 if i >= 100 else i} and {' '.join(f'p{5 if i >= 100 else i}x{k}' for k in range(12))}" for i, _, _ in rows}


def test_pages_with_other_articles_are_other_pages(spark):
    """A hundred articles with one menu are a hundred pages of the host, so a passage on two more pages is a quotation."""
    quote = "to be or not to be that is the question we ask"
    rows = [(i, f"http://h/{i}", f"<nav>home news about</nav><article><p>Article {i}</p></article>") for i in range(100)]
    rows += [(i, f"http://h/{i}", f"<p>Own {' '.join(f'p{i}x{k}' for k in range(10))}</p><p>{quote}</p>") for i in (200, 201)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "Article 7" and got[200].endswith(quote) and got[201].endswith(quote)


def test_articles_reach_the_suffix_arrays(spark, monkeypatch):
    """A host of articles alone has its shared runs listed, those inside the articles with the pages that hold them."""
    kept = {}
    plain = html.keep
    monkeypatch.setattr(html, "keep", lambda df, label, **options: kept.setdefault(label, plain(df, label, **options)))
    notice = " ".join(f"n{k}" for k in range(9))
    rows = [(i, f"http://h/{i}", f"<footer>{notice}</footer><article><p>a{i}</p>" + f"<p>{notice}</p>" * (i > 1) + "</article>") for i in range(5)]
    html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert [(r._pages, r._out) for r in kept["counted-runs"].collect()] == [(5, 5)] * 2
    assert kept["shared-runs"].count() == 2


@pytest.mark.parametrize("pages", [3, 256])
def test_hosts_with_and_without_articles_against_brute_force(spark, monkeypatch, pages):
    """Words of an article stay and count; what two pages hold outside articles and enough pages anywhere leaves the others."""
    monkeypatch.setattr(html, "PAGES", pages)
    rng = random.Random(22)
    common = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(9, 14))) for _ in range(30)]
    some = lambda k: [rng.choice(common) if rng.random() < 0.3 else " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 25))) for _ in range(k)]
    made = [(some(3) if rng.random() < 0.7 else [], some(2), some(1)) for _ in range(140)]
    made += [made[0], made[1]]  # pages that come twice
    rows = [(i, "http://h/", "<nav>" + "".join(menu) + "</nav>" + ("<article>" + "".join(f"<p>{b}</p>" for b in article) + "</article>" if article else "".join(f"<p>{b}</p>" for b in blocks)))
            for i, (article, blocks, menu) in enumerate(made)]
    runs = lambda words: set(zip(*[words[k:] for k in range(html.SHARED)]))
    outside = lambda article, blocks, menu: " ".join(([] if article else blocks) + menu).split(" ")
    different = {row[2]: (runs(outside(*m)), runs(" ".join(m[0]).split(" "))) for row, m in zip(rows, made)}
    out, anywhere = Counter(r for o, _ in different.values() for r in o), Counter(r for o, a in different.values() for r in o | a)
    shared = {r for r, k in anywhere.items() if out[r] > 1 and k >= html.SHARE * len(different)}
    assert shared and any(out[r] < html.SHARE * len(different) for r in shared) and any(k > 1 and r not in shared for r, k in out.items())
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (article, blocks, menu) in enumerate(made):
        words, left, at = outside(article, blocks, menu), [], 0
        covered = np.zeros(len(words), bool)
        for k in range(len(words) - html.SHARED + 1):
            covered[k : k + html.SHARED] |= tuple(words[k : k + html.SHARED]) in shared
        for b in [] if article else blocks:
            stays = html._own_words(covered[at : at + len(b.split(" "))])
            at += len(stays)
            if stays.any():
                left.append(" ".join(w for w, s in zip(b.split(" "), stays) if s))
        assert got[i] == "\n".join(article or left)
