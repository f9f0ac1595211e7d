"""A tolerant reader of HTML: block elements with what their names say about them, and blocks of text in page order.

Inline elements are transparent, so an unclosed <b> changes nothing.  A block element is known by its style (tag, class,
id and role without long numbers) and by its path, a hash of the styles from the root down; a box without a name also by
its place among such boxes, up to the eighth.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import xxhash

_set = lambda names: frozenset(names.split())
# fixed values: names of elements, attributes' words and roles
RAW = _set("script style noscript template title textarea iframe xmp noframes noembed")
VOID = _set("area base br col embed hr img input link meta param source track wbr")
NEVER = _set("head nav footer aside form button select datalist object svg canvas menu dialog audio video map fieldset frameset")
CONTENT = _set("article main")
TEXTUAL = _set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption address hr details summary")
BLOCKS = NEVER | CONTENT | TEXTUAL | _set("html body div section header center hgroup search")
ROLES = _set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist")
WORDS = _set(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar side aside footer foot masthead topbar banner ad ads adv advert adverts advertisement advertising sponsor sponsored"
    " promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended"
    " recommendations widget comment comments reply replies discussion disqus respond pagination pager toolbar skip copyright disclaimer"
)
HEADER_WORDS = _set("header head")
#: What makes an article or main no content of the page.
OTHER_ARTICLES = _set("ad ads advert advertisement sponsored promo comment comments reply replies related recommended teaser")
CLOSES = {"li": ("li", _set("ul ol menu")), "dt": ("dt dd", _set("dl")), "dd": ("dt dd", _set("dl")), "tr": ("tr td th", _set("table")), "td": ("td th", _set("tr table")), "th": ("td th", _set("tr table"))}

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:-->|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>\x00]*)([^\"'<>]*+(?:\"[^\"]*\"[^\"'<>]*+|'[^']*'[^\"'<>]*+)*+)>|<(/?)([a-zA-Z][^\s/>\x00]*)([^>]*)(?:>|\Z)",
    re.S,
)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d{3,}")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Page:
    """Block elements in order of their start, and (element, text, characters within links) of each block of text."""

    parents: list[int] = field(default_factory=lambda: [-1])
    tags: list[str] = field(default_factory=lambda: [""])
    paths: list[int] = field(default_factory=lambda: [0])
    styles: list[int] = field(default_factory=lambda: [0])
    dropped: list[bool] = field(default_factory=lambda: [False])  # by its name or one above it
    content: list[bool] = field(default_factory=lambda: [False])  # an article or main
    named: list[bool] = field(default_factory=lambda: [False])  # has a class or id
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


_styles: dict[str, tuple[int, int, bool, frozenset[str]]] = {}


def _look(tag: str, attributes: str) -> tuple[int, bool, bool, frozenset[str]]:
    """Hash of the style, whether the element is hidden, whether it has a name, and the words of its names."""
    key = f"{tag} {attributes}" if attributes else tag
    found = _styles.get(key)
    if found is None:
        names, hidden, role = "", False, ""
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if name in ("class", "id"):
                names += f" {value}"
            elif name == "role":
                role = value.lower()
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
                hidden = True
        style = f"{tag} {' '.join(sorted(_DIGITS.sub('', names).split()))} {role}"
        words = frozenset(w.lower() for w in _WORD.findall(names)) | ({f"role:{role}"} if role else set())
        found = xxhash.xxh64_intdigest(style) >> 1, hidden, bool(names.strip()), words
        if len(_styles) > 50_000:
            _styles.clear()
        _styles[key] = found
    return found


def parse(text: str) -> Page:
    page = Page()
    stack, buffer = [0], []
    boxes: dict[tuple[int, int], int] = {}
    linked = 0
    in_link, skip = False, ""  # skip: the inline element whose text does not count
    skipped = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            words = " ".join("".join(buffer).split())
            if words:
                page.blocks.append((stack[-1], words, min(linked, len(words))))
            buffer.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not skip:
            raw = html.unescape(raw) if "&" in raw else raw
            buffer.append(raw)
            if in_link:
                linked += len(raw)

    def close_to(depth: int) -> None:
        nonlocal skip
        flush()
        del stack[depth:]
        skip = ""

    at = 0
    while True:
        m = _TOKEN.search(text, at)
        if m is None:
            say(text[at:])
            break
        say(text[at : m.start()])
        at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            continue
        ends, attributes = m.group(1) or m.group(4), m.group(3) if m.group(2) else m.group(6)
        if ends:
            if skip == tag:
                skipped -= 1
                skip = "" if skipped == 0 else skip
            if tag == "a":
                in_link = False
            elif tag in BLOCKS:
                for depth in range(len(stack) - 1, 0, -1):
                    if page.tags[stack[depth]] == tag:
                        close_to(depth)
                        break
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(text, at)
            at = end.end() if end else len(text)
            continue
        if tag == "a":
            in_link = True
        if tag == "br":
            say(" ")
        if tag in BLOCKS and page.tags[stack[-1]] == "head":
            close_to(len(stack) - 1)
        if tag not in BLOCKS:
            if skip == tag:
                skipped += 1
            elif attributes and not skip and tag not in VOID:
                _, hidden, _, words = _look(tag, attributes)
                if hidden or not words.isdisjoint(WORDS):
                    skip, skipped = tag, 1
            continue
        flush()
        if page.tags[stack[-1]] == "p" or tag[0] == "h" and tag[1:].isdigit() and page.tags[stack[-1]][:1] == "h" and page.tags[stack[-1]][1:].isdigit():
            close_to(len(stack) - 1)
        if tag in CLOSES:
            names, scope = CLOSES[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if page.tags[stack[depth]] in scope:
                    break
                if page.tags[stack[depth]] in names.split():
                    close_to(depth)
                    break
        style, hidden, named, words = _look(tag, attributes)
        above = stack[-1]
        is_content = (tag in CONTENT or "role:main" in words) and words.isdisjoint(OTHER_ARTICLES)
        plain = tag in ("html", "body")
        drop = hidden or tag in NEVER or not plain and not is_content and (not words.isdisjoint(WORDS) or any(f"role:{r}" in words for r in ROLES) or tag in CONTENT)
        if not plain and not is_content and not page.content[above] and (tag == "header" or not words.isdisjoint(HEADER_WORDS)):
            drop = drop or not _within_content(page, above)
        page.parents.append(above)
        page.tags.append(tag)
        page.styles.append(style)
        place = 0
        if tag in ("div", "section") and not named:
            place = boxes.get((above, style), 0)
            boxes[above, style] = min(place + 1, 7)
        page.paths.append(xxhash.xxh64_intdigest(f"{page.paths[above]} {style} {place}") >> 1)
        page.dropped.append(drop)
        page.content.append(is_content)
        page.named.append(named)
        if tag not in VOID:
            stack.append(len(page.tags) - 1)
    flush()
    _settle(page)
    return page


def _within_content(page: Page, node: int) -> bool:
    while node > 0:
        if page.content[node]:
            return True
        node = page.parents[node]
    return False


def _settle(page: Page) -> None:
    """A name drops no element that holds an article or main; what is dropped takes along all below."""
    n = len(page.tags)
    holds = list(page.content)
    for k in range(n - 1, 0, -1):
        if page.tags[k] in NEVER:
            holds[k] = False
        elif holds[k]:
            holds[page.parents[k]] = True
    for k in range(1, n):
        page.dropped[k] = page.dropped[page.parents[k]] or page.dropped[k] and not holds[k]
