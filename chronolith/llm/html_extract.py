"""Main-text extraction with a site style tree.

Pages are parsed into text blocks in time linear in their length. A block belongs to an
element path (the host, then tags with their class and id from the root down), and a path
has in each page a presentation: the tags of its children in order, repeats made one.

What the markup itself calls boilerplate goes by rule: tags such as nav, footer and form,
roles, hidden elements, and classes or ids made of boilerplate words and words of layout
alone (``ad-slot``, ``site-footer``; not ``notice-of-award``). Where a page has an article
or main element, only what lies in it can stay. What then remains are a page's candidates,
and the style tree decides about them, inside articles as well.

The pages of a host are merged into a style tree, a row for each path and for each text of
a path. Copies of an article must not look like a menu, so a text does not count pages but
*contexts*: the context of a text in a page is a min-hash of all other candidates there
(its own hash, if it is more than half of the page). Copies share it, near copies mostly
do; a notice stands in nearly as many contexts as there are articles. With k contexts of a
text and m of its path (at least the greatest k), the text's importance is 1 - log_m(k): 0
for what every article of the host shows, 1 for what one shows. A path's importance is the
mean over its texts, weighed with the entropy, base m, of its parent's presentations. A
block goes if its path's importance is under ``threshold`` and its own text has at least
``min_pages`` contexts, and in DIFFERENT of its distinct pages; headings and table cells of
an article or main element never go: articles share them. So a passage that many articles
quote among their own paragraphs stays, and the repeated parts of a template go.

Everything is keyed by 64-bit hashes of texts and paths and counted by partial sums, so a
hot host spreads over all tasks. The keys of texts that go meet the pages that show them in
a join by text, and each page gets its own keys by a join by page: nothing of a host is
ever held or sent along as a whole.

Defined cases: null or empty html gives an empty text; a null url or one without host is a
host of its own name ''; repeated rows get equal texts and count as one page; an empty
table gives an empty table; hosts with fewer than ``min_pages`` contexts lose nothing to
the tree; where rules leave no text, the form or marked element that holds most stays,
and so does a form with more text than the rest; an open quote, comment or script takes the rest of the page, as in browsers;
input columns named text or n_chars are replaced, all others stay.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.llm.shared import kept, replaced, small_batches, spare, texts, widened, without

#: Importance under which a path's blocks go, and the contexts in which it must have come.
THRESHOLD, MIN_PAGES = 0.35, 5
#: Weight of the parent's presentation against the content.
PRESENTATION = 0.1

#: Bytes of a window in a page's context, and the least part of a text's pages that must differ in context.
WINDOW, DIFFERENT = 16, 0.25
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: A comment, other markup, or a tag. Quotes count behind "=" alone, and no part gives back what it took.
_MARKUP = re.compile(
    r"<(?:(?P<comment>!--)|(?P<other>[!?]|/(?![A-Za-z]))"
    r"|(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attributes>(?:[^=>]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z))"
)
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"([^\s=/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?+|'([^']*+)'?+|([^\s\"']\S*+)))?+")
_LONG_REFERENCE = re.compile(r"&#([xX]?)0*+([0-9a-fA-F]*+);?")

_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
_TABLE = frozenset("table tr tbody thead tfoot td th".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Tags that close an open paragraph when they begin.
_ENDS_P = _BLOCK - frozenset("body caption html option tbody td tfoot th thead tr".split())
#: Elements over which no end tag and no implied end reaches.
_BOUNDS = frozenset("table td th caption object template button svg math".split())
#: Elements that can stand in a head.
_IN_HEAD = frozenset("base basefont bgsound link meta title noscript script style template noframes head".split())
#: Elements that hold no article text.
_DROP = frozenset("head nav footer aside button select datalist dialog menu object svg canvas audio video map template search".split()) | _RAW
_ROLES = frozenset("navigation banner search form alert dialog alertdialog menu menubar complementary contentinfo toolbar tooltip".split())
#: Words of class and id that mark boilerplate, whatever stands around the element.
_FIRM = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense comment comments disqus replies reply respond responses related recommended recommendations "
    "promo promos promoted share sharing social sponsor sponsored sponsors outbrain taboola".split()
)
#: Words of class and id that mark boilerplate unless a main element stands in it or all the page's text does.
_SOFT = frozenset(
    "banner banners breadcrumb breadcrumbs consent cookie cookies footer footers gdpr login masthead menu menus modal nav navbar navigation navs newsletter newsletters notice notices pager paging pagination popup popups "
    "overlay sidebar sidebars signup signin subscribe subscription toolbar topbar widget widgets".split()
)
#: Words of layout, which say nothing by themselves.
_LAYOUT = frozenset(
    "a area areas article articles bar block blocks body bottom box boxes button buttons card cards center col column container content contents cta desktop entry fixed float footer form global group header home "
    "icon icons inline inner item items left lg line link links list lists lower main md media message messages middle mini mobile module news outer page panel post posts primary reader readers region right row secondary "
    "section sections side site slot slots sm small sticky stories story strip tertiary thread top unit units upper user users wide wp wrap wrapper x xs zone".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6 th td dt caption figcaption".split())
_SCOPE = frozenset("article main".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


def _hint(token: str) -> str:
    """'firm', 'soft', 'head' or '' for a class or an id: a boilerplate word, with words of layout beside it alone."""
    words = [w.lower() for w in _PARTS.findall(token)]
    if any(w not in _FIRM and w not in _SOFT and w not in _LAYOUT for w in words):
        return ""
    if any(w in _FIRM for w in words):
        return "firm"
    if any(w in _SOFT for w in words):
        return "soft"
    return "head" if words and words[-1] == "header" and set(words) <= {"header", "site", "page", "main", "top", "global", "mobile", "desktop", "primary"} else ""


@lru_cache(1 << 14)
def _marked(tag: str, attributes: str, scoped: bool) -> tuple[str, str]:
    """(the element's name with class and id, 'firm' or 'soft' if its markup calls it boilerplate, else '')."""
    plain = "firm" if tag in _DROP or tag == "header" and not scoped else "soft" if tag == "form" else ""
    if not attributes or attributes.isspace():
        return tag, plain
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    own, name = found.get("class", ""), found.get("id", "")
    label = f"{tag}.{' '.join(own.split())}#{name}" if own or name else tag
    if tag in ("html", "body"):
        return label, ""
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _NO_DISPLAY.search(found.get("style", "")):
        return label, "firm"
    if plain == "firm" or tag == "main":
        return label, plain
    named = _hint(name) if tag not in _HEADING else ""  # the id of a heading, or of an article's section, may come from its words
    hints = {*map(_hint, own.split()), named if named == "firm" or not scoped or tag != "section" else ""}
    if tag == "article":
        return label, "firm" if hints & {"firm"} else ""
    if "firm" in hints or found.get("role", "").lower() in _ROLES:
        return label, "firm"
    return label, "soft" if "soft" in hints or "head" in hints and not scoped else plain


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _plain(text: str) -> str:
    """Character references decoded; a number beyond Unicode is U+FFFD, however long."""
    if "&" not in text:
        return text
    short = lambda m: m[0] if len(m[2]) <= 8 else "�"
    return entities.unescape(_LONG_REFERENCE.sub(short, text) if "&#" in text else text)


@lru_cache(1 << 16)
def _path(label: str, up: int) -> int:
    return _hash(label, up)


class Block:
    """A run of text: its path, its parent's path, and what rules say about it."""

    __slots__ = ("text", "path", "parent", "scoped", "heading", "firm", "soft", "softs")

    def __init__(self, text: str, node: _Node, parent: _Node):
        self.text, self.path, self.parent = text, node.path, parent.path
        self.scoped, self.heading, self.firm, self.soft, self.softs = node.scoped, node.heading, node.firm, node.soft, node.softs


class _Node:
    """An open element; soft is the number of its outermost soft mark, below 0 for a form, softs how many there are, forms how many of them are forms."""

    __slots__ = ("tag", "path", "scoped", "heading", "firm", "soft", "softs", "forms", "block", "children")

    def __init__(self, tag: str, path: int, scoped: bool, heading: bool, firm: bool, marks: tuple[int, int, int], block: int):
        self.tag, self.path, self.scoped, self.heading, self.firm, self.block, self.children = tag, path, scoped, heading, firm, block, []
        self.soft, self.softs, self.forms = marks


def parse(page: str | None, host: str = "") -> tuple[list[Block], dict[int, list[str]]]:
    """(text blocks in page order, presentation of each path where it first ends)."""
    page = page or ""
    stack = [_Node("", _path("", _hash(host)), False, False, False, (0, 0, 0), 0)]
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag stands
    bounds, barriers = [0], [0]  # where elements stand that stop an end tag, and an implied end
    blocks, styles, said, marks = [], {}, [], 0
    search = _MARKUP.search

    def flush() -> None:
        text = " ".join(_plain("".join(said)).split())
        said.clear()
        if text:
            at = stack[-1].block
            blocks.append(Block(text, stack[at], stack[max(0, at - 1)]))

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            at = len(stack)
            places[node.tag].pop()
            if bounds[-1] == at:
                bounds.pop()
            if barriers[-1] == at:
                barriers.pop()
            if node.path not in styles:
                styles[node.path] = node.children

    def close_last(*tags: str, within: int) -> None:
        """Closes the outermost of the innermost open elements of these tags that stand inside ``within``."""
        found = [places[t][-1] for t in tags if places[t] and places[t][-1] > within]
        if found:
            close(min(found))

    at, n = 0, len(page)
    while at < n:
        m = search(page, at)
        start = m.start() if m else n
        if start > at:
            text = page[at:start]
            node = stack[-1]
            if node.tag == "head" and not text.isspace():
                close(len(stack) - 1)
                node = stack[-1]
            block = stack[node.block]
            if node.firm == block.firm and node.softs == block.softs:  # not from an inline element that is boilerplate in a block that is not
                said.append(text)
        if m is None:
            break
        at = m.end()
        comment, other, ends, tag, attributes = m.groups()
        if tag is None:
            if comment:
                end = _COMMENT_END.search(page, start + 2)
                at = end.end() if end else n
            else:
                at = page.find(">", at) + 1 or n
            continue
        tag = tag.lower()
        block = tag in _BLOCK
        if block and said:
            flush()
        if ends:
            if tag == "br":
                said.append(" ")
            if places[tag] and tag not in ("html", "body"):
                depth = places[tag][-1]
                if depth >= bounds[-1] and (block or depth >= barriers[-1]) or tag in _TABLE:
                    close(depth)
            continue
        if tag in ("html", "body", "head") and (places[tag] or tag == "head" and places["body"]):
            continue
        if stack[-1].tag == "head" and tag not in _IN_HEAD:
            close(len(stack) - 1)
        if places["p"] and tag in _ENDS_P:
            close_last("p", within=bounds[-1])
        if tag in _TABLE or tag == "caption":
            table = places["table"][-1] if places["table"] else 0
            if tag != "table":
                close_last("td", "th", *(() if tag in ("td", "th") else ("tr", "caption")), *(() if tag in ("td", "th", "tr") else ("tbody", "thead", "tfoot")), within=table)
        elif tag in ("li", "dd", "dt", "option"):
            same = ("dd", "dt") if tag in ("dd", "dt") else (tag,)
            if stack[barriers[-1]].tag in same:
                close(barriers[-1])
        up = stack[-1]
        label, marked = _marked(tag, attributes, up.scoped)
        if not up.children or up.children[-1] != label:
            up.children.append(label)
        if tag in _VOID:
            if tag == "br":
                said.append(" ")
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = page.find(">", end.start()) + 1 or n if end else n
            continue
        if places["svg"] and attributes.endswith("/"):
            continue
        firm, soft, softs, forms = up.firm or marked == "firm", up.soft, up.softs, up.forms
        if tag == "main" or tag == "article" and softs == forms:
            soft = softs = forms = 0
        if marked == "soft":
            marks += 1
            soft, softs, forms = soft or (-marks if tag == "form" else marks), softs + 1, forms + (tag == "form")
        here = len(stack)
        stack.append(_Node(tag, _path(label, up.path), up.scoped or tag in _SCOPE and not firm, tag in _HEADING or up.heading and tag not in _SCOPE, firm, (soft, softs, forms), here if block else up.block))
        places[tag].append(here)
        if tag in _BOUNDS:
            bounds.append(here)
        if block and tag not in ("address", "div", "p") or tag in _BOUNDS:
            barriers.append(here)
    if said:
        flush()
    close(1)
    return blocks, styles


def candidates(blocks: list[Block]) -> list[Block]:
    """The blocks that rules let stay."""
    stay = [b for b in blocks if not b.firm and not b.softs]
    held: dict[int, int] = defaultdict(int)
    for b in blocks:
        if not b.firm and b.softs == 1:
            held[b.soft] += len(b.text)
    if held:
        most = max(held, key=lambda k: (held[k], -abs(k)))
        if not stay or most < 0 and held[most] > sum(len(b.text) for b in stay):  # the page lies in a form, or in what only looks like boilerplate
            stay = [b for b in blocks if not b.firm and (not b.softs or b.softs == 1 and b.soft == most)]
    return [b for b in stay if b.scoped] if any(b.scoped for b in stay) else stay


def keys_of(blocks: list[Block]) -> list[int]:
    """What the style tree knows each block by: its path and its text, and apart if it is an article's heading or cell."""
    return [_hash(b.text, b.path + fixed(b)) for b in blocks]


def fixed(b: Block) -> int:
    """1 for an article's heading or table cell, else 0."""
    return int(b.scoped and b.heading)


def contexts(blocks: list[Block]) -> tuple[int, list[int]]:
    """(the page's context, that of each block): the least hash of any WINDOW bytes of all texts, and of all other texts; of itself, if it is more than half of all."""
    if not blocks:
        return 0, []
    each = [b.text.encode("utf-8", "surrogatepass") for b in blocks]
    raw = b"".join(each) + bytes(WINDOW)
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    n = len(raw) - WINDOW
    with np.errstate(over="ignore"):
        mixed = words[:n].copy()
        for shift, at in ((29, 8), (31, None)):
            mixed ^= mixed >> np.uint64(shift)
            mixed *= _ODD
            if at:
                mixed += words[at : at + n]
        mixed ^= mixed >> np.uint64(30)
    least: dict[str, int] = {}
    for b, x in zip(blocks, np.minimum.reduceat(mixed, np.cumsum([0, *map(len, each[:-1])])).view(np.int64).tolist()):
        least[b.text] = min(least.get(b.text, x), x)
    size, ordered = sum(map(len, least)), sorted(least.values())
    other = lambda t: _hash(t) if 2 * len(t) > size else ordered[least[t] == ordered[0]]
    return ordered[0], [other(b.text) for b in blocks]


_SEEN = pa.schema([("page", pa.int64()), ("path", pa.int64()), ("parent", pa.int64()), ("key", pa.int64()), ("fixed", pa.int32()), ("context", pa.int64()), ("own", pa.int64()), ("kind", pa.int32())])


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_SEEN``: kind 0 a path's presentation (as key), kind 1 a candidate text."""
    for batch in batches:
        rows = []
        for number, host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            blocks, styles = parse(page, host)
            blocks = candidates(blocks)
            own, each = contexts(blocks)
            shown = {b.parent for b in blocks}
            rows += [(number, p, 0, _hash("\0".join(styles[p])), 0, own, own, 0) for p in shown & styles.keys()]
            rows += sorted({(number, b.path, b.parent, k, fixed(b), c, own, 1) for b, k, c in zip(blocks, keys_of(blocks), each)})
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SEEN)], schema=_SEEN)


def style_tree(seen: DataFrame) -> DataFrame:
    """(key, fixed, pages, k, m, path_importance) for the texts in rows of ``_SEEN``."""
    seen = seen.distinct()  # copies of a page count once
    said = seen.where("kind = 1").groupBy("path", "parent", "key", "fixed", "context").agg(F.count(F.lit(1)).alias("n"))
    k = said.groupBy("path", "parent", "key", "fixed").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("pages"))
    k, _ = kept(seen.sparkSession, k, "style-texts")
    pages = seen.where("kind = 1").select("path", "own").distinct().groupBy("path").agg(F.count(F.lit(1)).alias("m"))
    paths = k.groupBy("path", "parent").agg(F.max("k").alias("most"), F.avg(F.log("k")).alias("logk")).join(pages, "path").withColumn("m", F.greatest("most", "m"))
    looks = seen.where("kind = 0").select("path", "key", "own").distinct().groupBy("path", "key").agg(F.count(F.lit(1)).alias("k"))
    looks = looks.groupBy("path").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log("k")).alias("klogk"))
    looks = looks.select(F.col("path").alias("parent"), F.when(F.col("n") > 1, (F.col("n") * F.log("n") - F.col("klogk")) / (F.col("n") * F.log("n"))).otherwise(1.0).alias("presentation"))
    content = F.when(F.col("m") > 1, 1 - F.col("logk") / F.log("m")).otherwise(1.0)
    weighed = paths.join(looks, "parent", "left").select("path", "m", (F.lit(PRESENTATION) * F.coalesce("presentation", F.lit(1.0)) + F.lit(1 - PRESENTATION) * content).alias("path_importance"))
    return k.join(weighed, "path").select("key", "fixed", "pages", "k", "m", "path_importance")


def low_keys(tree: DataFrame, threshold: float, min_pages: int) -> DataFrame:
    """The keys of texts that go."""
    often = (F.col("k") >= min_pages) & (F.col("k") >= F.lit(DIFFERENT) * F.col("pages"))
    return tree.where(often & (F.col("path_importance") < threshold) & (F.col("fixed") == 0)).select("key").distinct()


def main_text(page: str | None, host: str = "", low: frozenset | set = frozenset()) -> str:
    """The candidates that stay, joined by newlines; low: keys of texts that the host's style tree cuts."""
    blocks = candidates(parse(page, host)[0])
    if low:
        blocks = [b for b, k in zip(blocks, keys_of(blocks)) if k not in low]
    return "\n".join(b.text for b in blocks)


def _extracted(batches: Iterator[pa.RecordBatch], host: str, low: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [main_text(page, at, set(x or ())) for page, at, x in zip(texts(batch, "html"), texts(batch, host), batch.column(batch.schema.names.index(low)).to_pylist())]
        got = replaced(batch, {"text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())})
        yield got.select([n for n in got.schema.names if n not in (low, host)])


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def observe(pages: DataFrame) -> DataFrame:
    """Rows of ``_SEEN`` for pages (page hash, host, html)."""
    return pages.mapInArrow(_observed, "page long, path long, parent long, key long, fixed int, context long, own long, kind int")


def extract(spark: SparkSession, pages: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` (url, html and others) with text and n_chars."""
    small_batches(spark)
    pages = without(pages, ["text", "n_chars"])
    host, page, low, of = spare(pages, "host", "page", "low", "of")
    schema = widened(pages, [("text", T.StringType()), ("n_chars", T.LongType())])
    hosted = pages.withColumn(host, host_of(F.col("url")))
    number = F.xxhash64(F.col(host), F.col("html"))
    seen, _ = kept(spark, observe(hosted.select(number.alias("page"), F.col(host).alias("host"), "html")), "style-seen")
    gone, _ = kept(spark, low_keys(style_tree(seen), threshold, min_pages), "style-low")
    cut = seen.where("kind = 1").select("page", "key").join(gone, "key").groupBy("page").agg(F.collect_set("key").alias(low))  # at most a page's own texts
    cut, _ = kept(spark, cut.withColumnRenamed("page", of), "style-cut")
    met = hosted.withColumn(page, number).join(cut, F.col(page) == F.col(of), "left")
    return met.select(*[f"`{c}`" for c in pages.columns], host, low).mapInArrow(lambda it: _extracted(it, host, low), schema)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).drop("html")
