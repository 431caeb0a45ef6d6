"""HTML extraction with a site style tree.

The DOMs of a host's pages are merged by path: an element's path is the chain of
its tags, classes, ids and roles.  A node of presentation is important when the
pages arrange its children in many ways, a node of content when its sentences,
links and pictures differ from page to page; both are entropies with the number
of pages that have the node as their base.  The importance of a branch is the mean
of its nodes', those far below its top counting less.  Branches below ``LOW`` go
from every page.

What markup states outright comes first: navigation, footers, forms, adverts and
the like go, and where a page marks its article only that is kept.  The tree then
judges what is left, with two bounds: of a marked article it takes only branches
that carry a class, id or role, and it never takes the branch that holds more than
half of a page's text, so copies of one article are not mistaken for a template.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.llm.common import slices, texts_of

#: Importance under which a branch is noise, and what each level below its top weighs.
LOW, DECAY = 0.35, 0.9
#: Pages of a host that a node needs for its entropy to speak.
MIN_PAGES = 8
#: Levels of the tree; elements further down count for their ancestor there.
DEPTH = 32
#: Noise paths that are sent to every task; more of them are joined instead.
BROADCAST_ROWS = 100_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_HEAD = frozenset("title meta link base script style noscript template".split())
_NOISE = frozenset("nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu head audio video datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_WORDS = frozenset(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs crumbs sidebar footer masthead header topbar banner ad ads advert adverts advertisement advertisements advertising sponsor sponsored "
    "promo promotion promoted cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup signin login share sharing social comment comments disqus "
    "reply replies respond responses related recommended recommendations pagination pager toolbar widget widgets skip toc".split()
)
#: What makes an article one of the page's comments or adverts.
_NOT_ARTICLE = frozenset("comment comments reply ad ads advert sponsored promo related teaser".split())
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")
_SENTENCE = re.compile(r"[.!?|:;·•\n]+")
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")

#: A comment, tag or declaration; the last forms are cut off or have a quote open.
_MARKUP = re.compile(r"""<(?:!--(?:.*?)(?:-->|\Z)|(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<raw>(?:[^>"']|"[^"]*"|'[^']*')*)>|[!?/][^>]*(?:>|\Z)|[A-Za-z][^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Elements whose content is no markup, and their ends.
_RAW = {t: re.compile(rf"(?i)</{t}(?=[\s/>])") for t in ("script", "style", "title", "textarea")}
#: The open elements that one of these ends, and what they do not reach beyond.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
}

BY_TAG, BY_WORD = 1, 2


def hash63(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) & (1 << 63) - 1


@lru_cache(1 << 14)
def _below(path: int, label: str) -> int:
    return hash63(f"{path} {label}")


@lru_cache(1 << 14)
def _worded(names: str) -> bool:
    """Whether a class or id holds a word for noise."""
    return not _WORDS.isdisjoint(w.lower() for w in _SPLIT.split(names))


def attributes(raw: str) -> dict[str, str]:
    """An element's attributes, the first of a name counting."""
    out: dict[str, str] = {}
    for name, *value in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescape("".join(value)))
    return out


@lru_cache(1 << 14)
def _judged(tag: str, raw: str) -> tuple[str, int, int, bool]:
    """(label in the tree, kind of noise, 2 for an article and 1 for a main part, marked) of an element."""
    attrs = attributes(raw)
    names, role = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip(), attrs.get("role", "").lower().strip()
    noise = 0
    if tag in _NOISE or role in _ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style", "")):
        noise = BY_TAG
    elif tag == "article":
        noise = BY_TAG if _NOT_ARTICLE.intersection(names.lower().split()) else 0
    elif tag == "header" or (tag not in ("html", "body", "main") and names and _worded(names)):
        noise = BY_WORD
    root = 2 if "article" in (tag, role) else 1 if "main" in (tag, role) else 0
    return _DIGITS.sub("#", f"{tag}.{names}/{role}"), noise, root, bool(names or role)


class Page:
    """Elements in document order, each after its parent, and blocks of text.
    Markup that is broken or cut off never fails."""

    def __init__(self, html: str):
        self.parent, self.path, self.noise, self.root, self.marked, self.depth = [-1], [0], [0], [0], [False], [0]
        self.labels, self.opened = [""], Counter()
        self.stack: list[tuple[int, str]] = [(0, "")]
        self.blocks: list[tuple[int, str]] = []
        self.links: list[tuple[int, str]] = []
        self.run: list[str] = []
        at = 0
        while (found := _MARKUP.search(html, at)) is not None:
            if found.start() > at:
                self.text(html[at : found.start()])
            at = found.end()
            tag = found["tag"]
            if tag is None:  # a comment or declaration
                continue
            tag = tag.lower()
            if found["close"]:
                self.end(tag)
                continue
            raw = found["raw"]
            self.start(tag, raw)
            if tag in _RAW and not raw.endswith("/"):
                stop = _RAW[tag].search(html, at)
                at = len(html) if stop is None else stop.start()
        if at < len(html):
            self.text(html[at:])
        self.flush()

    def text(self, data: str):
        self.run.append(unescape(data) if "&" in data else data)

    def flush(self):
        if self.run:
            text = " ".join("".join(self.run).split())
            self.run = []
            if text:
                self.blocks.append((self.stack[-1][0], text))

    def push(self, tag: str, raw: str):
        label, noise, root, marked = _judged(tag, raw)
        top = self.stack[-1][0]
        deep = self.depth[top] >= DEPTH
        self.labels.append(label)
        self.parent.append(top)
        self.path.append(self.path[top] if deep else _below(self.path[top], label))
        self.depth.append(self.depth[top] + (not deep))
        self.noise.append(noise)
        self.root.append(root)
        self.marked.append(marked)
        self.stack.append((len(self.parent) - 1, tag))
        self.opened[tag] += 1

    def close_to(self, tags, until=()):
        """Ends the innermost open element of ``tags``, unless one of ``until`` is nearer."""
        if not any(self.opened[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][1] in tags:
                self.flush()
                self.opened.subtract(t for _, t in self.stack[k:])
                del self.stack[k:]
                return
            if self.stack[k][1] in until:
                return

    def start(self, tag: str, raw: str):
        if tag == "br":
            self.run.append("\n")
        elif tag in _VOID:
            if tag == "hr":
                self.flush()
            elif tag == "img" and (where := attributes(raw).get("src")):
                self.links.append((self.stack[-1][0], where))
        elif tag in _INLINE:
            if tag == "a" and (where := attributes(raw).get("href")):
                self.links.append((self.stack[-1][0], where))
            if raw and _judged(tag, raw)[1]:
                self.flush()
                self.push(tag, raw)
        else:
            self.flush()
            if tag not in _HEAD:
                self.close_to(("head",))
            top = self.stack[-1][1]
            if top == "p" or top in _INLINE:
                self.close_to(("p",), ("div", "section", "article", "main", "body", "li", "td"))
            if tag in _CLOSES:
                self.close_to(*_CLOSES[tag])
            self.push(tag, raw)

    def end(self, tag: str):
        if tag in _INLINE:
            if self.stack[-1][1] == tag:
                self.close_to((tag,))
        elif tag not in _VOID:
            self.flush()
            self.close_to((tag,))


def tree_rows(page: Page) -> set[tuple[int, int, int]]:
    """(path, kind, value) that one page adds to its site's tree: 0, the page
    itself; 1, how an element's children are arranged; 2, its content."""
    rows = {(p, 0, 0) for p in page.path[1:]}
    children: dict[int, list[str]] = {}
    for i in range(1, len(page.parent)):
        children.setdefault(page.parent[i], []).append(page.labels[i])
    rows |= {(page.path[i], 1, hash63("\n".join(c))) for i, c in children.items() if i}
    rows |= {(page.path[i], 2, hash63(s)) for i, text in page.blocks if i for s in _SENTENCE.split(text) if s}
    return rows | {(page.path[i], 2, hash63(f"\n{w}")) for i, w in page.links if i}


def ancestors(page: Page) -> dict[int, list[int]]:
    """Path to the paths above it, nearest first, itself included."""
    out: dict[int, list[int]] = {}
    for i in range(1, len(page.parent)):
        if page.path[i] not in out:
            up = out.get(page.path[page.parent[i]], [])
            out[page.path[i]] = [page.path[i], *up]
    return out


def extract(html: str, low: frozenset[int] = frozenset()) -> tuple[str, int, int, int]:
    """(text, blocks, blocks that markup excludes, blocks that the tree excludes)."""
    page = Page(html)
    n = len(page.parent)
    noise, root, has_root, chars = [False] * n, [0] * n, [False] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if has_root[i] or (page.root[i] and not page.noise[i]):
            has_root[page.parent[i]] = True
    for i in range(1, n):
        up, kind = page.parent[i], page.noise[i]
        # a heading band inside the article belongs to it
        own = kind == BY_TAG or (kind == BY_WORD and not has_root[i] and not (root[up] == 2 and page.labels[i].startswith("header.")))
        noise[i] = noise[up] or own
        root[i] = max(root[up], page.root[i])
    left = [(i, t) for i, t in page.blocks if not noise[i]]
    best = max((root[i] for i, _ in left), default=0)
    left = [(i, t) for i, t in left if root[i] >= best]
    total = sum(len(t) for _, t in left)
    for i, t in left:
        chars[i] += len(t)
    for i in range(n - 1, 0, -1):
        chars[page.parent[i]] += chars[i]
    gone = [False] * n
    if low:
        for i in range(1, n):
            judged = page.path[i] in low and (root[i] < 2 or page.marked[i]) and 2 * chars[i] <= total
            gone[i] = gone[page.parent[i]] or judged
    kept = [t for i, t in left if not gone[i]]
    return "\n\n".join(kept), len(page.blocks), len(page.blocks) - len(left), len(left) - len(kept)


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.when(host != "", F.xxhash64(host)).alias("site"))


def style_tree(pages: DataFrame) -> DataFrame:
    """(site, path, pages, importance): the merged tree of every host, one row for
    each node.  Rows of a node are counted by value with partial sums, so a host
    of a third of all pages is as many small groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "html"):
                out, above = [], []
                sites = part.column("site").to_pylist()
                for i, html in texts_of(part, "html"):
                    page = Page(html)
                    rows, up = tree_rows(page), ancestors(page)
                    out += [(sites[i], *r) for r in rows]
                    above += [up[p] if kind == 0 else None for p, kind, _ in rows]
                cols = list(zip(*out)) or [[]] * 4
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), pa.array(above, pa.list_(pa.int64()))], names=["site", "path", "kind", "value", "above"])

    seen = _with_host(pages).where("site is not null").select("site", "html").mapInArrow(run, "site long, path long, kind int, value long, above array<long>")
    values = seen.groupBy("site", "path", "kind", "value").agg(F.count("*").alias("n"), F.min("above").alias("above"))
    of = lambda k, c: F.sum(F.when(F.col("kind") == k, c))
    log = F.log("n")
    nodes = values.groupBy("site", "path").agg(
        of(0, F.col("n")).alias("pages"), F.min("above").alias("above"), of(1, F.col("n")).alias("styles"), of(1, F.col("n") * log).alias("style_logs"), of(2, F.lit(1)).alias("features"), of(2, log).alias("feature_logs")
    )
    base = F.log("pages")
    shown = F.when(F.col("styles") > 0, F.least(F.lit(1.0), (F.log("styles") - F.col("style_logs") / F.col("styles")) / base))
    said = 1 - F.col("feature_logs") / (F.col("features") * base)
    own = F.when(F.col("pages") < 2, 1.0).otherwise(F.coalesce((shown + said) / 2, shown, said, F.lit(0.0)))
    up = nodes.select("site", "pages", own.alias("own"), F.posexplode("above").alias("far", "path"))
    weight = F.col("pages") * F.pow(F.lit(DECAY), F.col("far"))
    # a node is its own nearest ancestor, so each has a row with its own number of pages
    return up.groupBy("site", "path").agg(F.max(F.when(F.col("far") == 0, F.col("pages"))).alias("pages"), (F.sum(weight * F.col("own")) / F.sum(weight)).alias("importance"))


SCHEMA = "text string, n_blocks long, n_by_markup long, n_by_tree long"


def _apply(low: dict[int, frozenset[int]] | None):
    """Texts of pages, with noise paths by site or in a column of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "html"):
                sites = part.column("site").to_pylist()
                noise = [low.value.get(s, frozenset()) for s in sites] if low is not None else [frozenset(x or ()) for x in part.column("low").to_pylist()]
                cols = list(zip(*(extract(html, noise[i]) for i, html in texts_of(part, "html")))) or [[]] * 4
                made = [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *made], names=["page_id", "url", "text", "n_blocks", "n_by_markup", "n_by_tree"])

    return run


def _page_paths(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "html"):
                out, keys, sites = [], part.column("key").to_pylist(), part.column("site").to_pylist()
                for i, html in texts_of(part, "html"):
                    out += [(keys[i], sites[i], p) for p in set(Page(html).path[1:])]
                cols = list(zip(*out)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()))], names=["key", "site", "path"])

    return pages.mapInArrow(run, "key string, site long, path long")


def main_text(pages: DataFrame, low: float = LOW, min_pages: int = MIN_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, text, n_blocks, n_by_markup, n_by_tree), one row per input row.

    Character references are decoded, white space within a block is one space,
    blocks are joined in page order by an empty line.  Null or empty html has an
    empty text; a page whose url is null or names no host is judged by its markup
    alone; repeated rows get a row each and count as often in their site's tree,
    equal ones alike; nothing is ordered but blocks, so there are no ties; a very
    long page is parsed whole, by itself; an empty table gives none; other columns
    are ignored.

    Noise paths, each seen on ``min_pages`` pages at least, go to every task if
    they are at most ``broadcast_rows``; otherwise pages meet theirs in a join by
    site and path, and get them back by the digest of their html.
    """
    spark: SparkSession = pages.sparkSession
    kind = dict(pages.dtypes)["page_id"]
    schema = f"page_id {kind}, url string, {SCHEMA}"
    hosted = _with_host(pages)
    noise = style_tree(pages).where((F.col("pages") >= min_pages) & (F.col("importance") < low)).select("site", "path")
    # at most one row more than the bound comes to the driver, whatever the size of the tree
    few = noise.limit(broadcast_rows + 1).collect()
    if len(few) <= broadcast_rows:
        by_site: dict[int, set[int]] = {}
        for site, path in few:
            by_site.setdefault(site, set()).add(path)
        return hosted.mapInArrow(_apply(spark.sparkContext.broadcast({s: frozenset(p) for s, p in by_site.items()})), schema)
    keyed = hosted.withColumn("key", F.sha2(F.concat(F.coalesce(F.col("site").cast("string"), F.lit("")), F.lit(" "), "html"), 256))
    found = _page_paths(keyed.where("site is not null").select("key", "site", "html").dropDuplicates(["key"])).join(noise, ["site", "path"])
    own = found.groupBy("key").agg(F.collect_set("path").alias("low"))
    return keyed.join(own, "key", "left").select("page_id", "url", "html", "site", "low").mapInArrow(_apply(None), schema)
