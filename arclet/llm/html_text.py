"""Main text of web pages: flat text blocks, told apart by a decision tree.

A page is cut into flat blocks at tags that start a new line. A block's features are its word count and link density, those
of the blocks before and after it, and what the elements around it say, by their tags and, weakly, by their names. A
tree, trained here on the blocks of a few labelled pages, says which blocks are the article.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import share_code

# Elements by what they do to a page's text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html iframe legend li main menu nav noscript object ol optgroup option p pre section select summary svg table tbody td textarea tfoot th thead title tr ul video audio".split()
)
RAW_TAGS = frozenset("script style textarea title noscript template iframe svg math noembed noframes xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = frozenset("p li dd dt tr td th option".split())
AROUND_TAGS = frozenset("nav header footer aside menu dialog button select option label legend fieldset noscript".split())
ARTICLE_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dd dt".split())
AROUND_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements banner breadcrumb breadcrumbs cookie cookies consent footer header menu modal nav navbar navigation newsletter "
    "notice overlay pager pagination popup promo promoted promotion recommended related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
COMMENT_NAMES = frozenset("comment comments disqus replies reply respond".split())
ARTICLE_NAMES = frozenset("article content entry main post story body text".split())
#: Names with one of these say how a page is laid out, not what an element is.
LAYOUT_NAMES = frozenset("no has with without enabled disabled layout wrapper hide show is left right".split())
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())

ATTRIBUTE = re.compile(r"([a-zA-Z][^\s=/>\"']*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
TAG_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
IN_TAG = re.compile("[>\"']")
#: Elements that "/>" ends at once, and a slash that is the last of an unquoted value, so that it ends nothing.
FOREIGN = frozenset("svg math".split())
IN_VALUE = re.compile(r"=\s*[^\s\"'>]*/$")
#: A bit for each element that another of its kind ends, and elements beyond which none does.
ENDING = {tag: 1 << i for i, tag in enumerate(sorted(SELF_CLOSING))}
HOLDING = BLOCK_TAGS - SELF_CLOSING
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "tag", "name", "form", "heading", "item")

#: The labelled pages: {n} stands for n words, and what an element with y holds is the article's.
LABELLED = (
    # elements that say what they are
    "<header><h1>{2}</h1></header><nav><ul><li><a>{1}</a><li><a>{2}</a><li><a>{1}</a></ul></nav><article y><h1>{9}</h1><p>{60}<p>{8}<p>{2}<p>{80}</article><footer>{9}</footer>",
    "<nav><a>{1}</a> <a>{1}</a></nav><main y><h2>{4}</h2><p>{25} <a>{3}</a> {12}</p><ul><li>{6}<li>{9}<li>{14}</ul><p>{40}</p><p>{3}</p></main><aside><h3>{2}</h3><p>{30}</p></aside><footer>{20} <a>{2}</a></footer>",
    "<div class=ad>{8}</div><article y><h1>{7}</h1><p>{4}</p><p>{1}</p><p>{120}</p><blockquote>{15}</blockquote></article><footer>{30}</footer>",
    "<article y><p>{12}</p><p>{3} <a>{2}</a></p><p>{2}</p></article><footer>{12}</footer>",
    "<header><p>{14}</p></header><article y><h1>{1}</h1><p>{1}</p></article><footer>{2}</footer>",
    "<article y><p>{90}</p><p>{2}</p><p>{150}</p><p>{1}</p><p>{60}</p><p>{5}</p><p>{3}</p><p>{4}</p><p>{70}</p></article><footer>{70}</footer>",
    # what stands in an article and isn't of it: link lists, adverts, notes
    "<article y><h1>{6}</h1><p>{45}</p><div y=0 class=advert>{20}</div><p>{30}</p><aside y=0>{25}</aside><p>{50}</p><ul y=0><li><a>{5}</a><li><a>{6}</a><li><a>{4}</a></ul></article>",
    "<main><div y><h1>{5}</h1><p>{70}</p><p>{20}</p></div><ul><li><a>{7}</a><li><a>{8}</a><li><a>{6}</a></ul><section class=comments><p>{25}</p><p>{40}</p><p>{3}</p></section></main>",
    "<article y><p>{50}</p><p>{9} <a>{1}</a></p><div y=0 class=share-bar><a>{1}</a> <a>{1}</a> {2}</div><div y=0 class=newsletter><p>{16}</p></div></article>",
    "<article y><h2>{5}</h2><p><a>{3}</a> {30}</p><p>{35}</p></article><div id=comments><h3>{2}</h3><article class=comment><p>{28}</p></article><article class=comment><p>{9}</p></article></div>",
    # what only its neighbours tell apart: a few words above a list of links, and a few words above text
    "<article y><h1>{6}</h1><p>{40}</p><p>{35}</p><p y=0>{3}</p><ul y=0><li><a>{5}</a><li><a>{7}</a></ul></article>",
    "<article y><h2>{3}</h2><p>{30}</p><h3 y=0>{2}</h3><p y=0><a>{6}</a></p><p y=0><a>{4}</a></p><h3>{2}</h3><p>{28}</p></article>",
    "<main y><p>{22}</p><p y=0>{4}</p><p y=0><a>{9}</a></p><p>{3}</p><p>{41}</p></main>",
    "<article y><p>{33}</p><p y=0><a>{3}</a></p><p y=0>{2}</p><p y=0><a>{4}</a></p><p>{5}</p><p>{26}</p></article>",
    # names only
    "<div class=header>{4}</div><div class=menu><a>{1}</a> | <a>{1}</a></div><div class=entry-content y><p>{55}</p><p>{6}</p><p>{44}</p></div><div class=sidebar><p>{35}</p><p>{15}</p></div><div class=footer>{12}</div>",
    "<div id=cookie-consent>{24} <a>{2}</a></div><div id=post y><h1>{8}</h1><p>{33}</p><p>{3}</p></div><div id=related><p><a>{7}</a></p><p><a>{6}</a></p></div>",
    # nothing but words and links, in plain elements
    "<div><a>{1}</a> <a>{2}</a> <a>{1}</a></div><div>{3}</div><div y><p>{40}</p><p>{35}</p><p>{11}</p><p>{60}</p></div><div><a>{3}</a></div><div>{4} <a>{1}</a></div><div><a>{2}</a> <a>{2}</a></div>",
    "<table><tr><td><a>{1}</a><td><a>{2}</a></tr></table><p y>{28}</p><p y>{9}</p><p y>{48}</p><p>{2}</p><p><a>{4}</a></p>",
    "<div><a>{2}</a></div><h1 y>{4}</h1><p y>{45}</p><p y>{3}</p><p y>{38}</p><p y>{1}</p><p y>{52}</p><p y>{5}</p><p y>{20}</p><div>{2}</div><div><a>{3}</a></div><div>{4}</div>",
    "<div>{2}</div><div>{3}</div><div>{1} <a>{2}</a></div><div y>{31}</div><div y>{4}</div><div y>{64}</div><div y>{2}</div><div y>{27}</div><div>{3}</div><div>{2}</div>",
    "<ul><li><a>{2}</a><li><a>{1}</a><li><a>{3}</a></ul><h1 y>{2}</h1><p y>{70}</p><p y>{8} <a>{2}</a> {25}</p><p y>{31}</p><div>{1} <a>{1}</a> <a>{1}</a></div><div>{5}</div>",
    "<div>{2} <a>{2}</a></div><div y>{22}</div><div y>{12}</div><div y>{26}</div><div><a>{6}</a></div><div>{3} <a>{5}</a></div>",
    "<p><a>{8}</a></p><p><a>{9}</a></p><p><a>{7}</a> {1}</p><h2>{3}</h2><p><a>{10}</a></p><p>{2}</p>",
    "<p y>{25}</p>",
    "<p>{3}</p><p><a>{2}</a></p>",
    "<div>{4}</div><div y>{18}</div><div y>{90}</div><div>{1}</div>",
    # a form about the page, and forms on it
    "<form><div><a>{1}</a> <a>{1}</a></div><div y><h1>{6}</h1><p>{42}</p><p>{38}</p></div><div><input>{2}</div></form>",
    "<form><p y>{20}</p><p y>{30}</p><p y>{16}</p><p y>{25}</p></form>",
    "<form><article y><h1>{5}</h1><p>{21}</p><p>{4}</p></article></form>",
    "<article y><p>{44}</p><form y=0>{3} <input> {2}</form><p>{3}</p><p>{39}</p></article><form><p>{5}</p><p>{12}</p></form>",
    "<form>{2}<input><p>{9}</p></form><p y>{36}</p><p y>{30}</p>",
)


@dataclass
class Node:
    """A leaf's verdict, or a feature and threshold with what lies at or below and above it."""

    verdict: bool
    feature: int = -1
    at: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None

    def report(self) -> dict[str, int]:
        """How often the tree splits on each feature."""
        if self.low is None:
            return {}
        counts = {FEATURES[self.feature]: 1}
        for part in (self.low.report(), self.high.report()):
            for k, n in part.items():
                counts[k] = counts.get(k, 0) + n
        return counts


def train_tree(table=None, depth: int = 9, least: int = 1) -> Node:
    """A classification tree by Gini impurity on rows (features, label); ties go to the first feature and the lowest threshold."""
    table = labelled_blocks() if table is None else table
    x, y = np.array([f for f, _ in table], float), np.array([label for _, label in table], float)

    def grow(rows, depth):
        own = y[rows]
        leaf = Node(bool(own.mean() >= 0.5) if len(own) else False)
        if depth == 0 or not len(own) or own.min() == own.max():
            return leaf
        best = None
        for j in range(x.shape[1]):
            values = np.unique(x[rows, j])
            for at in (values[1:] + values[:-1]) / 2:
                low = x[rows, j] <= at
                n, m = low.sum(), (~low).sum()
                if min(n, m) < least:
                    continue
                p, q = own[low].mean(), own[~low].mean()
                cost = n * p * (1 - p) + m * q * (1 - q)
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, j, at, low)
        if best is None:
            return leaf
        _, j, at, low = best
        return Node(leaf.verdict, j, float(at), grow(rows[low], depth - 1), grow(rows[~low], depth - 1))

    return grow(np.arange(len(y)), depth)


def classify(tree: Node, x) -> bool:
    while tree.low is not None:
        tree = tree.low if x[tree.feature] <= tree.at else tree.high
    return tree.verdict


def labelled_blocks(pages=LABELLED) -> list[tuple[tuple, int]]:
    """The labelled table: features and label of every block of the labelled pages."""
    return [(b.features, int(b.marked)) for page in pages for b in blocks(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), page))]


@dataclass
class State:
    """What an element and those around it say: tag and name are -1 around the article, 1 for it, 0 for nothing."""

    tag: int = 0
    name: int = 0
    comment: bool = False
    hidden: bool = False
    form: bool = False
    heading: bool = False
    item: bool = False
    marked: bool = False


@dataclass
class Block:
    state: State
    text: str
    words: int
    linked: int
    features: tuple = field(default=())

    @property
    def marked(self) -> bool:
        return self.state.marked


SAYING = AROUND_TAGS | ARTICLE_TAGS | HEADINGS | ITEMS | {"form"}


def _named(value: str) -> int:
    """What a class or id says: 2 for comments, -1 for what stands around an article, 1 for one."""
    return _known(value) if len(value) < 500 else _said(value)


def _said(value: str) -> int:
    said = 0
    for name in value.lower().split():
        parts = set(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name)))
        if parts & LAYOUT_NAMES:
            continue
        if parts & COMMENT_NAMES:
            return 2
        if parts & AROUND_NAMES:
            said = -1
        elif parts & ARTICLE_NAMES and said == 0:
            said = 1
    return said


#: Pages of a site say the same again and again.
_known = lru_cache(1 << 16)(_said)


def _inside(outer: State, tag: str, attributes: str) -> State:
    """The state inside an element that opens in another's. What is further in decides, but a name never calls back what an
    element around it has said, and an article among comments is one of them."""
    if not attributes and tag not in SAYING:
        return outer
    s = State(outer.tag, outer.name, outer.comment, outer.hidden, outer.form or tag == "form", outer.heading or tag in HEADINGS, outer.item or tag in ITEMS, outer.marked)
    if tag in AROUND_TAGS or tag == "form" and max(outer.tag, outer.name) > 0:
        # A form inside an article is none of it; one that an article, or all of a page, stands in says little.
        s.tag = -1
    elif tag in ARTICLE_TAGS and outer.tag >= 0:
        s.tag, s.name, s.form = 1, 0, False
    if "=" in attributes or "hidden" in attributes or " y" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id") and tag not in ("html", "body"):
                said = _named(value)
                s.comment |= said == 2
                if said < 0 or said == 1 and s.name == 0:
                    s.name = said
                    s.form &= said < 0
            elif name == "role":
                s.tag = -1 if value.lower() in AROUND_ROLES else 1 if value.lower() in ("main", "article") and s.tag >= 0 else s.tag
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value.lower()):
                s.hidden = True
            elif name == "y":
                s.marked = value != "0"
    if s.comment:
        s.name = -1
    return s


def _tags(page: str):
    """(start, end, name, closes, attributes) of tags, in order; name is empty for comments and declarations. Time is linear."""
    at, last, quotes = 0, page.rfind(">"), {q: page.rfind(q) for q in "\"'"}
    raw = ""
    while (start := page.find("<", at)) >= 0:
        if raw:
            # Up to the end of an element that holds no markup.
            end = re.compile(rf"</{re.escape(raw)}(?=[\s/>])", re.I).search(page, start)
            start = end.start() if end else -1
            raw = ""
            if start < 0 or start > last:
                yield at, len(page), "", False, None
                return
            yield at, start, "", False, None
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, "", False, ""
            continue
        name = TAG_NAME.match(page, start + 1)
        if name is None and page[start + 1 : start + 2] not in ("!", "?", "/"):
            at = start + 1
            continue
        if start > last:
            # A tag that the end of the page cuts short is no text.
            yield start, len(page), "", False, ""
            return
        end = name.end() if name else start + 1
        while (stop := IN_TAG.search(page, end)) is not None and stop[0] != ">":
            close = page.find(stop[0], stop.end()) if stop.end() <= quotes[stop[0]] else -1
            end = close + 1 if close >= 0 else stop.end()
        # A quotation that takes the last ">" with it was none.
        end = stop.end() if stop else page.find(">", start) + 1
        tag = name[1].lower() if name else ""
        yield start, end, tag, page[start + 1] == "/", page[name.end() : end - 1] if name else ""
        at = end
        if tag in RAW_TAGS and page[start + 1] != "/":
            raw = "" if tag in FOREIGN and page[end - 2 : end - 1] == "/" and not IN_VALUE.search(page, start, end - 1) else tag


def plain(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def blocks(page: str) -> list[Block]:
    """The flat blocks with text of a page, in order, with features. Markup may be unclosed or cut short."""
    found: list[Block] = []
    # Of each open element its kind, what it says, and which kinds that another ends are open in its block, as bits.
    stack: list[tuple[str, State, int]] = []
    count: dict[str, int] = {}
    links = 0
    text: list[str] = []
    linked: list[str] = []
    state = State()

    def flush():
        nonlocal text, linked
        if text:
            words = plain("".join(text)).split()
            if words and not state.hidden:
                found.append(Block(state, " ".join(words), len(words), len(plain("".join(linked)).split()) if linked else 0))
            text, linked = [], []

    def add(part: str):
        nonlocal state
        if part:
            if not text:
                state = stack[-1][1] if stack else State()
            text.append(part)
            if links:
                linked.append(part + " ")

    def close(tag: str):
        # Up to the element itself; what it left open ends with it.
        nonlocal links
        while count.get(tag):
            t = stack.pop()[0]
            count[t] -= 1
            links -= t == "a"
            if t == tag:
                return

    at = 0
    for start, end, tag, closes, attributes in _tags(page):
        if attributes is not None:
            add(page[at:start])
        at = end
        if not tag:
            continue
        if tag in BLOCK_TAGS:
            flush()
        if closes:
            close(tag)
            continue
        if tag in RAW_TAGS or tag in VOID_TAGS or attributes.endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag in ENDING and stack and stack[-1][2] & ENDING[tag]:
            close(tag)
        if tag == "body":
            # What the head left open is over.
            stack, count, links = [], {}, 0
        _, outer, ending = stack[-1] if stack else ("", State(), 0)
        stack.append((tag, _inside(outer, tag, attributes), 0 if tag in HOLDING else ending | ENDING.get(tag, 0)))
        count[tag] = count.get(tag, 0) + 1
        links += tag == "a"
    add(page[at:])
    flush()
    density = [min(1.0, b.linked / b.words) for b in found]
    for i, b in enumerate(found):
        before = (found[i - 1].words, density[i - 1]) if i else (0, 0.0)
        after = (found[i + 1].words, density[i + 1]) if i + 1 < len(found) else (0, 0.0)
        s = b.state
        b.features = (b.words, density[i], *before, *after, s.tag, s.name, int(s.form), int(s.heading), int(s.item))
    return found


def main_text(page: str | None, tree: Node) -> str:
    """The article's blocks joined by spaces; empty if there is none."""
    return " ".join(b.text for b in blocks(page or "") if classify(tree, b.features))


def _extract(tree: Node):
    def run(batches):
        for pdf in batches:
            texts = [main_text(h, tree) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return run


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: Node | None = None) -> DataFrame:
    """One row per row of df: page_id, url, text, n_chars (code points). Null or empty html gives an empty text; null ids and urls
    stay null, repeated rows are rows each, an empty table gives an empty one, and other columns of df are not looked at.

    Whole pages are read; nothing is shuffled, and a page takes time in proportion to its length, whatever its markup. It is held
    by one task. Character references are decoded once per block, white space inside a block becomes one space.
    """
    share_code(df.sparkSession)
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return pages.mapInPandas(_extract(tree or train_tree()), "page_id long, url string, text string, n_chars long")
