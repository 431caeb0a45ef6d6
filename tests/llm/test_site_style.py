"""HTML extraction: the site style tree against entropies counted plainly, and
pages whose text is known."""

import math
import random
import re
from collections import Counter, defaultdict
from html import unescape

import pytest

from scriptorium.llm import site_style
from scriptorium.llm.common import read

FIELDS = "page_id long, url string, html string, text string, path string, site string, pages long, low string"
WORDS = "amber birch cedar delta ember flint grove heath inlet jetty knoll larch marsh north ocean petal quartz ridge stone thorn".split()


def sentence(rng, n=9):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n)) + "."


def template_page(rng, k):
    """A page whose markup names nothing: what is noise shows across pages only."""
    paras = [sentence(rng, rng.randint(5, 30)) for _ in range(rng.randint(1, 7))]
    body = "".join(rng.choice(["<p>{}</p>", "<p>{}</p>", "<h2>{}</h2>", "<blockquote>{}</blockquote>"]).format(p) for p in paras)
    html = (
        "<html><head><title>t</title></head><body><div class='x1'><div>Harbour Gazette</div><div><a href='/a'>Home</a><a href='/b'>World</a></div></div>"
        f"<div class='x2'>{body}</div><div class='x3'><div>All rights kept. Write to us.</div><div>Printed by the harbour.</div></div></body></html>"
    )
    return html, "\n\n".join(paras)


def site_pages(n=40, seed=4):
    rng = random.Random(seed)
    rows, want = [], []
    for k in range(n):
        html, text = template_page(rng, k)
        rows.append((k, f"https://User@Gazette.example:80/{k}", html))
        want.append(text)
    return rows, want


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", 1, "x") for r in rows], FIELDS).repartition(3)


def texts(df):
    return Counter((r["page_id"], r["url"], r["text"]) for r in df.collect())


@pytest.mark.parametrize("bound", [site_style.BROADCAST_ROWS, 0])
def test_template_without_names(spark, bound):
    """Both ways of sending noise paths; a site of few pages keeps everything."""
    rows, want = site_pages()
    got = texts(site_style.main_text(frame(spark, rows), broadcast_rows=bound))
    assert got == Counter((*r[:2], w) for r, w in zip(rows, want))
    few = {r["page_id"]: r for r in site_style.main_text(frame(spark, rows[:5]), broadcast_rows=bound).collect()}
    assert all(few[k]["text"].startswith("Harbour Gazette") and few[k]["n_by_tree"] == 0 for k in few)


def plain_tree(rows):
    """Importance of every node, by counting over whole pages."""
    pages, styles, content, above = Counter(), defaultdict(Counter), defaultdict(Counter), {}
    for _, _, html in rows:
        page = site_style.Page(html)
        up = {i: [page.path[i]] + [] for i in range(len(page.parent))}
        for i in range(1, len(page.parent)):
            up[i] = [page.path[i], *(up[page.parent[i]] if page.parent[i] else [])]
            above[page.path[i]] = up[i]
        pages.update(set(page.path[1:]))
        kids = defaultdict(list)
        for i in range(1, len(page.parent)):
            kids[page.parent[i]].append(page.labels[i])
        for path, style in {(page.path[i], tuple(c)) for i, c in kids.items() if i}:
            styles[path][style] += 1
        said = {(page.path[i], s) for i, t in page.blocks for s in re.split(r"[.!?|:;·•\n]+", t) if s} | {(page.path[i], ("link", w)) for i, w in page.links}
        for path, value in said:
            content[path][value] += 1
    own = {}
    for path, m in pages.items():
        parts = []
        if m < 2:
            own[path] = 1.0
            continue
        if styles[path]:
            total = sum(styles[path].values())
            parts.append(min(1.0, -sum(n / total * math.log(n / total, m) for n in styles[path].values())))
        if content[path]:
            parts.append(1 - sum(math.log(n, m) for n in content[path].values()) / len(content[path]))
        own[path] = sum(parts) / len(parts) if parts else 0.0
    top, bottom = Counter(), Counter()
    for path, chain in above.items():
        for far, a in enumerate(chain):
            top[a] += pages[path] * 0.9**far * own[path]
            bottom[a] += pages[path] * 0.9**far
    return {p: (pages[p], top[p] / bottom[p]) for p in pages}


def test_tree_equals_plain_count(spark):
    rows, _ = site_pages(60)
    rng = random.Random(9)
    rows = [(k, u, h.replace("x1", rng.choice(["x1", "y"]))) for k, u, h in rows]
    got = {r["path"]: (r["pages"], r["importance"]) for r in site_style.style_tree(frame(spark, rows)).collect()}
    want = plain_tree(rows)
    assert got.keys() == want.keys()
    for p in want:
        assert got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 1e-9


def test_every_page_of_the_table(spark):
    """The articles of the driver's pages, read by a pattern made for their markup."""
    pages = read(spark, "/root/testdata/sf0.01", "pages")
    want = {}
    for r in pages.collect():
        article = re.search(r"(?s)<article>(.*)</article>", r["html"])[1].replace("<br>", " ")
        blocks = [re.sub("</?b>", "", x) for x in re.split("</?(?:p|h1)>", article)]
        want[r["page_id"]] = "\n\n".join(b for b in (" ".join(unescape(x).split()) for x in blocks) if b)
    assert {r["page_id"]: r["text"] for r in site_style.main_text(pages).collect()} == want


MARKED = """<!DOCTYPE html><HTML><head><title>Title &amp; more</title><script>if (a < b) document.write("<p>no</p>")</script><style>p{}</style>
<body class="has-sidebar"><header id=top><h1>Site name</h1></header><nav><ul><li>Menu<li>Other</ul></nav>
<div class="cookie-notice">We bake.</div><div class="layout no-sidebar"><main><article class="post"><header><h1>A &lt;b&gt; Caf&eacute;</h1></header>
<p>One <b>two<br>three</p> loose &#8212; text<p class='lead'>Four <a href="x">five</a>
<aside>Aside.</aside><div class="share">Share this</div><form><p>Mail <input name=a><button>Go</button></form>
<ul><li>six<li>seven &amp</ul><table><tr><td>8<td>9</table><pre>ten
eleven</pre><!-- <p>not this</p> --><p style="display: none">hidden<p>twelve &nbsp; thirteen</article>
<section id="comments"><h2>Comments</h2><article class="comment"><p>First!</article></section></main>
<aside>More</aside></div><footer>&copy; Foot</footer></body></html>"""


def test_marked_page():
    assert site_style.extract(MARKED)[0].split("\n\n") == ["A <b> Café", "One two three", "loose — text", "Four five", "six", "seven &", "8", "9", "ten eleven", "twelve thirteen"]


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        (None, ""),
        ("just words &amp; more", "just words & more"),
        ("<p>a<p>b", "a\n\nb"),
        ("<article><p>cut off in <a hre", "cut off in"),
        ("<article><p>open \" quote <a title=\"x>y</a> z</p><p>after</p>", "open \" quote y z\n\nafter"),
        ("<script>never closed <p>x", ""),
        ("<!-- never closed <p>x", ""),
        ("</div></p>a</article>b", "a\n\nb"),
        ("<div>a<div>b</div>c</div>", "a\n\nb\n\nc"),
        ("<p>a < b and 3 <4 &lt;i&gt;</p>", "a < b and 3 <4 <i>"),
        ("<main><p>m</p></main><p>outside</p>", "m"),
        ("<nav>only a menu</nav>", ""),
        ("<div class='ad'>buy</div><div class='additional'>keep</div>", "keep"),
    ],
)
def test_small_pages(spark, html, text):
    assert site_style.extract(html or "")[0] == text


def test_edges(spark):
    deep = "<div>" * 40_000 + "<p>deep" + "</div>" * 40_000
    long = "<article>" + "<p>word &amp; word</p>" * 60_000 + "</article>"
    copy = "<html><body><div class='t'>Top</div><div class='c'><p>" + "The one story told here. " * 9 + "</p></div></body></html>"
    rows = [(1, None, None), (None, "not an address", "<p>x"), (2, "http://a.example/", ""), (3, "http://a.example", deep), (4, "http://a.example?q", long)]
    rows += [(k, "http://copies.example/", copy) for k in range(100, 130)] + [(100, "http://copies.example/", copy)] * 2
    got = site_style.main_text(frame(spark, rows))
    assert got.columns == ["page_id", "url", "text", "n_blocks", "n_by_markup", "n_by_tree"]
    found = [tuple(r)[:3] for r in got.collect()]
    assert len(found) == len(rows)
    want = {1: "", None: "x", 2: "", 3: "deep", 4: "\n\n".join(["word & word"] * 60_000)}
    story = " ".join(["The one story told here."] * 9)
    for key, _, text in found:  # copies are no template: the branch with most text stays
        assert text == (want[key] if key is None or key < 100 else story)
    assert site_style.main_text(spark.createDataFrame([], FIELDS)).collect() == []
