"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: elements of the same path of styles (tag, class, id, role) are one node.
Two things are counted for a node, over the m pages that have it:

* presentation: how the node's child elements look; p_i is the share of pages with look i, and the importance
  -sum(p_i log_m p_i): a node that looks the same everywhere has none;
* content: the distinct blocks of text right under it; a block on c pages has entropy log_m c, and the importance is
  one minus the mean entropy of all distinct blocks in the branch: text that stands on every page has none.

A branch's importance weighs content by CONTENT_WEIGHT and presentation by the rest.  A node that is on few pages can't
be judged: it takes ``least_pages`` pages and a twentieth of the host's, so a host's list of low branches is at most
twenty times the elements of a page, whatever its pages.

A page's text is then made of what is left under its main or article elements: names alone (nav, footer, aside, forms,
scripts, classes of adverts, notices, comments, ...) drop a branch, and so does low importance, but for plain paragraphs,
headings, lists and tables.  Pages without such elements take the deepest single container that holds MAIN_SHARE of the
host's text of importance, without branches that are mostly links.

Statistics are aggregated by (host, node, look or block) before they are shuffled, so a host of a third of all pages is
no hot key.  What each host's tree says is one row a host; it is broadcast up to ``broadcast_hosts`` rows, else joined
by ``join_groups``, which leaves the pages of large hosts where they are.

Defined cases: null html is empty and gives the empty text; a url without a host belongs to no site, its pages are
judged by themselves; repeated ids stay separate rows; an empty table gives an empty result; other columns are not read,
whatever their names.  White space inside a block, no-break spaces too, is one space; an element's line breaks are
white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import join_groups, save, text_of
from telemill.llm.html_pages import TEXTUAL, Page, parse

CONTENT_WEIGHT, THRESHOLD, LEAST_PAGES, SHARE_OF_PAGES = 0.9, 0.3, 4, 20
#: Share of a host's text that its main container holds, and of a branch's text in links that makes it a menu.
MAIN_SHARE, LINK_SHARE = 0.6, 0.5
#: Times that a main container may be on a page on average: boxes in a row are parts of what holds them.
MOST_TIMES = 1.25
BROADCAST_HOSTS = 1 << 17
CONTAINERS = frozenset(("div", "section", "center", "body", "td"))
LOOK, BLOCK = 0, 1


def host_of(url: Column) -> Column:
    """The host of a url in lower case; null where it has none."""
    return F.nullif(F.regexp_extract(F.lower(url), "^\\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def _seen(page: Page) -> list[tuple[int, list[int], int, int, int, int, bool]]:
    """(node, nodes above it, kind, look or block, characters, times on the page, whether a container) of all live nodes."""
    n = len(page.tags)
    looks: dict[int, list[int]] = {}
    first: dict[int, int] = {}
    chars = [0] * n
    blocks: dict[tuple[int, int], None] = {}
    for node, text, _ in page.blocks:
        if not page.dropped[node]:
            chars[node] += len(text)
            blocks[page.paths[node], xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1] = None
    total, times = {}, {}
    for k in range(n):
        if page.dropped[k]:
            continue
        path = page.paths[k]
        first.setdefault(path, k)
        looks.setdefault(path, [])
        total[path] = total.get(path, 0) + chars[k]
        times[path] = times.get(path, 0) + 1
        if k:
            looks[page.paths[page.parents[k]]].append(page.styles[k])
    above: dict[int, list[int]] = {}
    for path, k in first.items():
        up, at = [], page.parents[k]
        while at >= 0:
            up.append(page.paths[at])
            at = page.parents[at]
        above[path] = up
    out = []
    for path, k in first.items():
        look = xxhash.xxh64_intdigest(repr(looks[path])) >> 1
        out.append((path, above[path], LOOK, look, total[path], times[path], page.tags[k] in CONTAINERS))
    out += [(path, above[path], BLOCK, block, 0, 0, False) for path, block in blocks]
    return out


def _stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["_host", "node", "above", "kind", "feature", "chars", "times", "container"]
    for batch in batches:
        rows = []
        for host, text in zip(batch["_host"], batch["_html"], strict=True):
            rows += [(host, *x) for x in _seen(parse(text))]
            if len(rows) > 50_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)


def style_trees(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per host and node: pages, importance of its presentation and content and of the branch, characters."""
    rows = pages.select(host_of(F.col(url_col)).alias("_host"), text_of(html_col).alias("_html")).where("_host IS NOT NULL")
    seen = rows.mapInPandas(_stats, "_host string, node long, above array<long>, kind int, feature long, chars long, times long, container boolean")
    key = ["_host", "node", "kind", "feature"]
    features = seen.groupBy(*key).agg(F.count("*").alias("c"), F.max("above").alias("above"), F.sum("chars").alias("chars"), F.sum("times").alias("times"), F.max("container").alias("container"))
    look, c = F.col("kind") == LOOK, F.col("c")
    nodes = features.groupBy("_host", "node").agg(
        F.max("above").alias("above"), F.max("container").alias("container"), F.sum(F.when(look, c)).alias("m"), F.sum(F.when(look, c * F.log("c")).otherwise(0.0)).alias("looks"),
        F.count_if(~look).alias("blocks"), F.sum(F.when(~look, F.log("c")).otherwise(0.0)).alias("logs"), F.sum("chars").alias("chars"), F.sum("times").alias("times"),
    )
    nodes = save(nodes, "site-nodes")
    log_m = F.log("m")
    entropy = F.when(F.col("m") > 1, F.col("logs") / log_m).otherwise(0.0)
    branch = nodes.select("_host", F.explode(F.concat("above", F.array("node"))).alias("node"), entropy.alias("entropy"), "blocks", "chars")
    branch = branch.groupBy("_host", "node").agg(*[F.sum(x).alias(f"all_{x}") for x in ("entropy", "blocks", "chars")])
    out = nodes.join(branch, ["_host", "node"])
    presentation = F.when(F.col("m") > 1, (log_m - F.col("looks") / F.col("m")) / log_m).otherwise(1.0)
    content = F.when(F.col("all_blocks") > 0, 1 - F.col("all_entropy") / F.col("all_blocks")).otherwise(presentation)
    out = out.select("_host", "node", "above", "container", "m", "times", presentation.alias("presentation"), content.alias("content"), "all_chars")
    return out.withColumn("importance", CONTENT_WEIGHT * F.col("content") + (1 - CONTENT_WEIGHT) * F.col("presentation"))


def judged(trees: DataFrame, threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row per host: _pages, its low branches, and its main container (null where none holds enough text)."""
    root = F.size("above") == 0
    whole = trees.where(root).select("_host", F.col("m").alias("_pages"))
    t = trees.join(whole, "_host")
    low = ~root & (F.col("importance") < threshold) & (F.col("m") >= least_pages) & (F.col("m") * SHARE_OF_PAGES >= F.col("_pages"))
    t = t.withColumn("_low", low)
    lows = t.where("_low").groupBy("_host").agg(F.array_sort(F.collect_list("node")).alias("_lows"))
    # characters of importance: those of a branch without its low branches; a low branch counts once, at its top
    inner = t.where("_low").select("_host", F.explode("above").alias("node"), F.col("node").alias("_of"), "above", "all_chars")
    top = inner.join(lows, "_host").where(F.size(F.array_intersect("above", "_lows")) == 0).groupBy("_host", "node").agg(F.sum("all_chars").alias("_lost"))
    t = t.join(top, ["_host", "node"], "left").withColumn("_chars", F.col("all_chars") - F.coalesce("_lost", F.lit(0)))
    text = t.where(root).select("_host", F.col("_chars").alias("_text"))
    main = t.where(F.col("container") & ~F.col("_low") & (F.col("times") <= MOST_TIMES * F.col("m"))).join(text, "_host").where((F.col("_text") > 0) & (F.col("_chars") >= MAIN_SHARE * F.col("_text")))
    main = main.groupBy("_host").agg(F.max_by("node", F.struct(F.size("above"), "_chars", "node")).alias("_main"))
    out = whole.join(lows, "_host", "left").join(main, "_host", "left")
    return out.select("_host", "_pages", F.coalesce("_lows", F.array().cast("array<long>")).alias("_lows"), "_main")


def text_blocks(page: Page, lows: frozenset[int], main: int | None) -> list[str]:
    """Blocks of the main text in page order."""
    n = len(page.tags)
    live = [not d for d in page.dropped]
    holds = list(page.content)
    for k in range(n - 1, 0, -1):
        holds[page.parents[k]] |= holds[k]
    if lows:
        for k in range(1, n):
            low = page.paths[k] in lows and not holds[k] and (page.named[k] or page.tags[k] not in TEXTUAL)
            live[k] = live[k] and live[page.parents[k]] and not low
    roots = [k for k in range(n) if page.content[k] and live[k]]
    for of_kind in (lambda k: page.tags[k] != "article", lambda k: True):
        inside = _below(page, [k for k in roots if of_kind(k)])
        found = [text for node, text, _ in page.blocks if live[node] and inside[node]]
        if found:
            return found
    if roots:
        return []
    chars, linked = [0] * n, [0] * n
    for node, text, in_links in page.blocks:
        if live[node]:
            chars[node] += len(text)
            linked[node] += in_links
    for k in range(n - 1, 0, -1):
        chars[page.parents[k]] += chars[k]
        linked[page.parents[k]] += linked[k]
    told = [True] * n
    for k in range(1, n):
        menu = linked[k] > LINK_SHARE * chars[k] and page.tags[k] not in ("body", "html")
        told[k] = told[page.parents[k]] and live[k] and not menu
    kept = [(node, text) for node, text, _ in page.blocks if told[node]]
    at = [k for k in range(n) if main is not None and page.paths[k] == main and told[k]]
    if main is None:
        at = _alone(page, kept)
    inside = _below(page, at)
    return [text for node, text in kept if inside[node]] or [text for _, text in kept]


def _below(page: Page, roots: list[int]) -> list[bool]:
    inside = [False] * len(page.tags)
    for k in roots:
        inside[k] = True
    for k in range(1, len(inside)):
        inside[k] = inside[k] or inside[page.parents[k]]
    return inside


def _alone(page: Page, kept: list[tuple[int, str]]) -> list[int]:
    """The deepest container of a page that belongs to no site which holds enough of its text."""
    chars = [0] * len(page.tags)
    for node, text in kept:
        chars[node] += len(text)
    for k in range(len(chars) - 1, 0, -1):
        chars[page.parents[k]] += chars[k]
    return [max(k for k in range(len(chars)) if k == 0 or page.tags[k] in CONTAINERS and chars[k] >= MAIN_SHARE * chars[0])]


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        known: dict[bytes, frozenset[int]] = {}
        out = []
        for text, lows, main in zip(batch["_html"], batch["_lows"], batch["_main"], strict=True):
            held = frozenset()
            if lows is not None and len(lows):
                key = lows.tobytes()
                held = known.setdefault(key, frozenset(lows.tolist()))
            out.append("\n".join(text_blocks(parse(text), held, None if main is None else int(main))))
        yield pd.DataFrame({"_id": batch["_id"], "_url": batch["_url"], "text": out})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """One row per page: id, url, and text, the main text with a line for each block."""
    hosts = save(judged(style_trees(pages, url_col, html_col), threshold, least_pages), "sites")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), text_of(html_col).alias("_html"))
    rows = rows.withColumn("_h", host_of(F.col("_url")))
    if hosts.count() <= broadcast_hosts:
        joined = rows.join(F.broadcast(hosts), F.col("_h") == F.col("_host"), "left")
    else:
        total = hosts.agg(F.sum("_pages")).first()[0] or 0
        alone = F.concat(F.lit("page "), F.xxhash64("_id", "_html").cast("string"))
        joined = join_groups(rows.withColumn("_h", F.coalesce("_h", alone)), hosts.withColumnRenamed("_host", "_h"), "_h", "_pages", total, alone)
    kind = rows.schema["_id"].dataType.simpleString()
    out = joined.select("_id", "_url", "_html", "_lows", F.col("_main").cast("string").alias("_main")).mapInPandas(_extract, f"_id {kind}, _url string, text string")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text")
