"""Site style trees against dictionaries, extraction against another reader of HTML and planted pages."""

import math
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

import __spark_entry__ as entry
from telemill.llm import site_tree
from telemill.llm.html_pages import parse

SF = "/root/testdata/sf0.001"


def text_of(html):
    return "\n".join(site_tree.text_blocks(parse(html), frozenset(), None))


class Article(HTMLParser):
    """Blocks of the article of a page of the test data."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        if tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


@pytest.mark.parametrize("html, want", [
    ("", ""),
    ("plain &amp; simple &copy;", "plain & simple ©"),
    ("<article><h1>T</h1><p><b>one<br><p>two &lt;b&gt;</article>", "T\none\ntwo <b>"),
    ("<nav>menu</nav><article>a<!-- x > y --><script>var t='</p>'</script> b</article><footer>f</footer>", "a b"),
    ("<main><h1>T</h1><aside>s</aside><article><p>a</p></article><div class='comments'><p>c</p></div></main>", "T\na"),
    ("<article><p>a</p><article class='comment'><p>c</p></article><form><p>f</p></form></article>", "a"),
    ("<body class='no-sidebar'><div id='page-header'>h</div><div class=content><p>long text of the page</p><p>and more</p></div><div class='side-bar ads'>ad</div>", "long text of the page\nand more"),
    ("<article><p>a <span class='share-buttons'>Tweet</span>b</p><p hidden>x</p><p style='display: none'>y</p></article>", "a b"),
    ("<div><ul><li><a href=/x>one</a><li><a href=/y>two</a></ul><p>the text that matters</p></div>", "the text that matters"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul></article>", "a\nb\nc\nx\ny"),
    ("<article><p title=\"a > b\">a  \n b</p>5 < 6 <p", "a b\n5 < 6"),
    ("<html><head><title>t<body></title><p>x</p>", "x"),
    ("<article><header><h1>T</h1></header><p>a</p><footer>by</footer></article>", "T\na"),
])
def test_reading(html, want):
    assert text_of(html) == want


def test_importance_against_dictionaries(spark):
    """Presentation and content importance by host, counted over all pages in plain Python."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    looks, blocks, above = defaultdict(Counter), defaultdict(Counter), {}
    for r in pages.collect():
        host = r.url.split("/")[2]
        for path, up, kind, feature, *_ in site_tree._seen(parse(r.html or "")):
            (looks if kind == site_tree.LOOK else blocks)[host, path][feature] += 1
            above[host, path] = up
    m = {key: sum(c.values()) for key, c in looks.items()}
    entropies = defaultdict(list)
    for (host, path), c in blocks.items():
        for x in c.values():
            for at in [path, *above[host, path]]:
                entropies[host, at].append(math.log(x, m[host, path]) if m[host, path] > 1 else 0)
    for r in site_tree.style_trees(pages).collect():
        key = (r["_host"], r.node)
        n = m.pop(key)
        p = 1 if n == 1 else -sum(c / n * math.log(c / n, n) for c in looks[key].values())
        c = 1 - sum(entropies[key]) / len(entropies[key]) if entropies[key] else p
        assert r.m == n and abs(r.presentation - p) < 1e-9 and abs(r.content - c) < 1e-9 and abs(r.importance - (0.9 * c + 0.1 * p)) < 1e-9
    assert not m


def _site(k):
    """A page without telling names: menu, notice and advert as plain boxes."""
    body = "".join(f"<div class=x7><p>Sentence {i} of text number {k} says {k * 31 + i} and nothing else at all.</p></div>" for i in range(1 + k % 5))
    return f"<body><div class=b1><a href=/a>Home</a> <a href=/b{k}>Topic {k}</a></div><div class=b2>We keep your data safe in our box.</div><div class=b3><h2>Title {k}</h2>{body}</div><div class=b4>All rights of this site are ours.</div>"


@pytest.mark.parametrize("broadcast_hosts", [1000, 0])
def test_planted_boxes(spark, broadcast_hosts):
    rows = [(k, f"http://{'Big' if k % 3 else 'h' + str(k % 4)}.example.org:80/{k}", _site(k)) for k in range(120)]
    rows += [(200, None, _site(200)), (201, "no url", _site(201)), (202, "http://one.example.org", _site(202))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in site_tree.extract(pages, broadcast_hosts=broadcast_hosts).collect()}
    assert len(got) == len(rows)
    for k, _, html in rows:
        lines = got[k].split("\n")
        want = [f"Sentence {i} of text number {k} says {k * 31 + i} and nothing else at all." for i in range(1 + k % 5)]
        assert [x for x in lines if x.startswith("Sentence")] == want
        assert not any(x.startswith("Topic") or "Home" in x for x in lines)
        if k < 200:
            assert lines == [f"Title {k}", *want]


def test_copies_stay(spark):
    """Exact copies of an article on a host are no boilerplate."""
    html = "<nav>n</nav><article><h1>T</h1><p>The same article.</p><div class=note>Same box</div></article>"
    pages = spark.createDataFrame([(k, "http://h.example/x", html if k < 8 else html.replace("same", str(k))) for k in range(12)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in site_tree.extract(pages).collect()}
    assert got[0] == "T\nThe same article." and got[9] == "T\nThe 9 article."


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "http://a.example", None), (1, "http://a.example", ""), (2, "http://a.example", "<p>x"), (2, "http://a.example", "<p>x"), (3, "", "<article>" + "<p>word</p>" * 30000 + "</article>")]
    pages = spark.createDataFrame([(*r, "n", 5) for r in rows], "page_id long, url string, html string, node string, _h int")
    for limit in (100, 0):
        got = sorted((r.page_id or 0, r.url, r.text) for r in site_tree.extract(pages, broadcast_hosts=limit).collect() if r.page_id != 3)
        assert got == [(0, None, ""), (1, "http://a.example", ""), (1, "http://a.example", ""), (2, "http://a.example", "x"), (2, "http://a.example", "x")]
        assert site_tree.extract(pages.limit(0), broadcast_hosts=limit).count() == 0
    long = site_tree.extract(pages.where("page_id = 3")).first()
    assert long.text == "\n".join(["word"] * 30000)


def test_query(spark):
    got = {r.page_id: r for r in entry.queries()["op11_site_tree"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        reader = Article()
        reader.feed(r.html or "")
        reader.close()
        want = "\n".join(filter(None, (" ".join(b.split()) for b in reader.blocks)))
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url
