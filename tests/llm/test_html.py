"""Main-text extraction: markup rules, the style tree against a plain one, hostile pages."""

import math
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chronolith.llm import html_extract as h

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("inner", [
    '<div class="ad">x</div>', '<div class="ad-slot">x</div>', '<div id="siteFooter">x</div>', '<div class="cookie-banner">x</div>', '<ul class="main-nav"><li>x</ul>', '<section id="comments"><p>x</section>',
    '<div role="navigation">x</div>', '<p hidden>x</p>', '<p style="color:red; display: none">x</p>', '<div class="left sidebar">x</div>', '<form><p>x</form>', '<div class="related-posts"><article><p>x</article></div>',
    '<div class="site-header">x</div>', '<nav>x</nav>', '<noscript>x</noscript>', "<template>x</template>", '<article class="comment"><p>x</article>', "<dialog>x</dialog>", "<!-- x -->", '<div class="notice">x</div>', '<div class="share_buttons">x</div>',
])
def test_boilerplate_goes(inner):
    assert h.main_text(f"<body><p>text</p>{inner}<p>more</p>") == "text\nmore"
    if "header" not in inner:
        assert h.main_text(f"<body><p>out</p><article><p>text</p>{inner}<p>more</p></article>") == "text\nmore"


@pytest.mark.parametrize("inner", [
    "<section class='related-work'><p>keep</p></section>", "<div class='notice-of-award'>keep</div>", "<div class='content has-sidebar'><p>keep</p></div>", "<div class='no-sidebar'>keep</div>", "<div id='page-with-login'>keep</div>",
    "<div class='ad-hoc'>keep</div>", "<div class='share-price'>keep</div>", "<div class='social-policy'>keep</div>", "<h2 id='navigation'>keep</h2>", "<section id='notices'><p>keep</section>", "<header><p>keep</p></header>", "<p class='shadow'>keep</p>",
])
def test_content_stays(inner):
    assert h.main_text(f"<body><article><p>text</p>{inner}</article>") == "text\nkeep"


def test_page_wide_marks_do_not_empty_a_page():
    assert h.main_text("<body><form id=f><nav>n</nav><div><p>the article of a page in a form</p></div></form><p>c</p>") == "the article of a page in a form\nc"
    assert h.main_text("<form><article><p>in</p></article></form><p>out</p>") == "in"
    assert h.main_text("<div class='modal'><main><p>in</p></main></div>") == "in"
    assert h.main_text("<div class='menu'><p>only this</p><div class='login'>x</div></div>") == "only this"
    assert h.main_text("<div class='sidebar'><article><p>card</p></article></div><p>text</p>") == "text"


def test_markup_as_browsers_read_it():
    assert h.main_text("<p>a <b title='x > y' data=\"<p>\">b</b> 1 < 2 <!-->c<!-- d --!>e<?x y?>f</ g>h") == "a b 1 < 2 cefh"
    assert h.main_text("<p>a<div>b</p>c</div><p>d<span></p>e</span>") == "a\nb\nc\nd\ne"
    assert h.main_text("<head><title>t</title><p>no head end") == "no head end" == h.main_text("<head>no head end")
    assert h.main_text("<p>a<script>var s='</p><p>x'</script >b<style>y") == "ab"
    assert h.main_text("<p>&#65;&#0000000066;&#99999999999;&#x43;&amp;amp;&nbsp;&copy 1</p>") == "AB�C&amp; © 1"
    assert h.main_text("<table><tr><td>a<td>b<table><tr><td>c</table>d<tr><td>e</table>") == "a\nb\nc\nd\ne"
    assert h.main_text("<dl><dt>a<dd>b<dt>c</dl><ul><li>d<div>e<li>f</ul>") == "a\nb\nc\nd\ne\nf"


@pytest.mark.parametrize("page", [
    "<a '" * 250_000, "<div>x" * 100_000, "<" * 1_000_000, '<p class="' * 100_000, "<!--" * 250_000, "<title>" * 100_000, "<b>" * 60_000 + "</i>" * 60_000, "<table><tr>" * 20_000 + "<td>x" * 60_000,
    "<ul><li>a" * 40_000, "<a =" * 250_000, "&#" + "9" * 1_000_000 + ";", "<a b" + " " * 1_000_000, "<a " + "b= " * 250_000 + ">t", "&amp" * 250_000,
], ids=range(14))
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    h.main_text(page)
    assert time.perf_counter() - began < 20


def window_hash(raw):
    """The hash of 16 bytes, by whole numbers."""
    mask, odd, x = (1 << 64) - 1, 0x9E3779B97F4A7C15, int.from_bytes(raw[:8], "little")
    x = ((x ^ x >> 29) * odd + int.from_bytes(raw[8:16], "little")) & mask
    x = (x ^ x >> 31) * odd & mask
    x ^= x >> 30
    return x - (1 << 64 if x >= 1 << 63 else 0)


def plain_contexts(stay):
    raw = [b.text.encode() for b in stay]
    whole, least, at = b"".join(raw) + bytes(16), {}, 0
    for b, r in zip(stay, raw):
        own = min((window_hash(whole[i : i + 16]) for i in range(at, at + len(r))), key=lambda x: x % (1 << 64))
        least[b.text] = min(least.get(b.text, own), own)
        at += len(r)
    size = sum(map(len, least))
    return min(least.values(), default=0), {t: t if 2 * len(t) > size else min((x for u, x in least.items() if u != t)) for t in least}


def plain_tree(pages, threshold=h.THRESHOLD, min_pages=h.MIN_PAGES):
    """The texts of (host, html) pages, by a style tree in plain dictionaries."""
    where, count, own, looks, parent = defaultdict(set), defaultdict(int), defaultdict(set), defaultdict(lambda: defaultdict(set)), {}
    known = lambda b: (b.path, b.text, b.scoped and b.heading)
    for host, page in dict.fromkeys(pages):
        blocks, styles = h.parse(page, host)
        stay = h.candidates(blocks)
        whole, each = plain_contexts(stay)
        for b in {known(b): b for b in stay}.values():
            where[known(b)].add(each[b.text])
            count[known(b)] += 1
            own[b.path].add(whole)
            parent[b.path] = b.parent
        for p in {b.parent for b in stay} & styles.keys():
            looks[p][tuple(styles[p])].add(whole)
    gone = set()
    for path in own:
        k = {key: len(c) for key, c in where.items() if key[0] == path}
        m = max(len(own[path]), *k.values())
        importance = lambda n: 1 - math.log(n) / math.log(m) if m > 1 else 1.0  # noqa: B023, E731
        counts = [len(x) for x in looks[parent[path]].values()]
        total = sum(counts)
        entropy = -sum(c / total * math.log(c / total) for c in counts) / math.log(total) if total > 1 else 1.0
        mean = h.PRESENTATION * entropy + (1 - h.PRESENTATION) * sum(map(importance, k.values())) / len(k)
        for key, n in k.items():
            if n >= min_pages and n >= h.DIFFERENT * count[key] and mean < threshold and not key[2]:
                gone.add(key)
    return [(host, page, "\n".join(b.text for b in h.candidates(h.parse(page, host)[0]) if known(b) not in gone)) for host, page in pages]


def site(rng, host, n):
    """Pages of a site whose boilerplate no markup names."""
    menu = "".join(f"<div class='x{i}'><span>{host} part {i}</span></div>" for i in range(4))
    for i in range(n):
        story = "".join(f"<p>{' '.join(rng.choice('abcdefghij') * rng.randint(2, 5) for _ in range(rng.randint(3, 30)))}</p>" for _ in range(rng.randint(1, 5)))
        inner = f"<h1>Story {i}</h1><h2>Summary</h2>{story}<div class=x>Write to the editors of {host} if you like it</div><p>One passage that all of them quote</p><p>The end</p>"
        if rng.random() < 0.3:
            inner += f"<div class=y>Sometimes the people of {host} say one thing more</div>"
        yield (host, f"<body>{menu}{'<article>' + inner + '</article>' if host.startswith('a') else '<div>' + inner + '</div>'}<div>All of this is by {host}</div></body>")


def test_style_tree_equals_a_plain_one(spark):
    rng = random.Random(5)
    pages = [p for host, n in (("a.com", 25), ("b.com", 25), ("few.com", 3), ("a2.com", 6)) for p in site(rng, host, n)]
    pages += [p for host in ("a.com", "m.com") for p in [(host, f"<body><article><p>{'one story told again ' * 9}</p><p>Its end was never in doubt at all {i // 2}</p></article></body>") for i in range(12)]]
    pages += pages[:5]
    rows = [(i, f"http://{host}/{i}", page) for i, (host, page) in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in h.extract(spark, spark.createDataFrame(rows, PAGES)).collect()}
    want = plain_tree(pages)
    assert [got[i] for i in range(len(rows))] == [t for _, _, t in want]
    for i, (host, _, text) in enumerate(want):
        if host == "a.com" and "Story" in text:  # inside an article only the tree can tell
            assert "Summary" in text and "The end" in text and "all of them quote" in text
            assert "Write to the editors" not in text and "part" not in text
        if host == "b.com":
            assert not any(x in text for x in ("part", "Write to", "All of this")) and "Story" in text
        if host == "m.com":  # mirrors of one article
            assert text.count("\n") == 1
        if host == "few.com":
            assert "part 0" in text and "Write to" in text


def test_no_input_column_is_lost(spark):
    rows = [(1, "http://a.com/1", "<p>x", "h", "l", "p", 5)]
    got = h.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string, host string, _low string, _host string, N_CHARS int"))
    assert got.columns == ["page_id", "url", "html", "host", "_low", "_host", "text", "n_chars"]
    assert tuple(got.first()) == (1, "http://a.com/1", "<p>x", "h", "l", "p", "x", 1)


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no host", "<p>a"), (3, "no host", "<p>a"), (4, "http://x.com", "<p>" + "word " * 300_000), (None, "http://x.com", "<b>")]
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in h.extract(spark, spark.createDataFrame(rows, PAGES)).collect())
    long = ("word " * 300_000).strip()
    assert got == [(0, "", 0), (1, "", 0), (2, "", 0), (3, "a", 1), (3, "a", 1), (4, long, len(long))]
    assert h.extract(spark, spark.createDataFrame(rows, PAGES).where(F.lit(False))).count() == 0
