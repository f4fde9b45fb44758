"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their path of block tags, with their names, from the root. Each path has a text length,
a punctuation count, a share of links and a number of nodes; their ratios are smoothed over the page's nodes in order,
fused with where the path stands and what it is called, and compared with a threshold. The nodes of the paths beyond it
are the content. A page is read in time linear in its length, however badly it is nested.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks

#: Elements without a body, with raw text, never content, inline, and class or id words of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style noscript template textarea title iframe noembed noframes nav header footer aside button select svg canvas object audio video dialog menu".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
NO_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted menu nav navbar navigation breadcrumb breadcrumbs sidebar "
    "widget footer header masthead cookie cookies consent notice notices disclaimer alert comment comments discussion reply replies respond share sharing "
    "social related recommended newsletter subscribe subscription signup login popup modal overlay toolbar pagination pager copyright skip responses guestbook".split()
)
#: Words that say nothing of what a name is about; a name of these and of furniture is furniture's, one with other words may be content's.
NEUTRAL = frozenset(
    "a the and main top bottom left right side inner outer first last col column row box block list item items area bar wrap wrapper container content body "
    "section panel group set unit slot zone holder inline sticky fixed small large mobile desktop new page site global primary secondary form link links post posts "
    "article articles story stories text message msg title heading head icon button btn count thread tree user reader readers by on us me your our js is has".split()
)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
_EDGE = re.compile(r"[>\"']")
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[^a-z]+")
_HIDDEN = re.compile(r"(?:^|[\s\"'])hidden(?=[\s=/]|$)(?!\s*=\s*[\"']?until-found)|style\s*=\s*(?:\"[^\"]*|'[^']*|\S*)(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？]")

#: What a path keeps of its score under a furniture name, and the share of chosen text that the content's element holds.
NAMED_WEIGHT, HELD = 0.001, 0.9
#: Shares of the mean ratio: from which on a path tells where the content is, and from which on it is content.
CORE, LEAST = 0.5, 0.25
#: How far a name is that of furniture: not at all, among other words, or wholly.
NONE, PARTLY, WHOLLY = 0, 1, 2
#: Elements that can stand before the content's element and belong to it.
_LEADS = frozenset("h1 h2 h3 p".split())
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li td th tr pre blockquote".split())


class _Ends:
    """Where tags end. Quotes may hold ``>``, until a page turns out to leave a quote open; then they count no more."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.quotes = {q: page.rfind(q) for q in "\"'"}
        self.heeded = True

    def of(self, at: int) -> int:
        """Index behind the tag that begins before ``at``; -1 if none ends there. What is passed over is not read again."""
        if at > self.last:
            return -1
        k = at
        while self.heeded:
            m = _EDGE.search(self.page, k)
            if not m:
                self.heeded = False
            elif m[0] == ">":
                return m.end()
            elif m.end() <= self.quotes[m[0]]:
                k = self.page.index(m[0], m.end()) + 1
            else:
                k = m.end()
        return self.page.index(">", at) + 1


def furniture_name(names: str) -> int:
    """How far class, id and role words are those of page furniture."""
    level = NONE
    for name in names.split():
        words = set(_WORD.split(name)) - {""}
        if not FURNITURE.isdisjoint(words):
            level = max(level, WHOLLY if words <= FURNITURE | NEUTRAL else PARTLY)
    return level


class Tree:
    """A page's elements and text nodes, read once from front to back; what is hidden has no text nodes.

    For each element: parent, tag, path (numbers of equal chains of block tags with their names), how far its name is that
    of furniture, whether it is inside an article or main. A text node: element, number of the block, text, whether it is
    a link's.
    """

    def __init__(self, page: str):
        self.parent, self.tag, self.path, self.named, self.article, self.unseen = [-1], [""], [0], [NONE], [False], [False]
        self.block_of = [0]  # the nearest element that isn't inline
        self.texts: list[tuple[int, int, str, bool]] = []
        paths: dict[tuple, int] = {}
        open_, blocks, counts = [0], [0], {}  # open elements, those that aren't inline, and how often each tag is open
        hidden = links = block = at = 0
        ends = _Ends(page)

        def close() -> None:
            nonlocal hidden, links
            e = open_.pop()
            tag = self.tag[e]
            counts[tag] -= 1
            hidden -= self.unseen[e]
            links -= tag == "a"
            if blocks[-1] == e:
                blocks.pop()

        def close_to(e: int) -> None:
            while open_[-1] >= e:  # elements are numbered as they open
                close()

        def text(a: int, b: int) -> None:
            if not hidden and a < b:
                self.texts.append((open_[-1], block, html.unescape(page[a:b]), links > 0))

        while at < len(page):
            lt = page.find("<", at)
            if lt < 0:
                text(at, len(page))
                break
            text(at, lt)
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = end + 3 if end >= 0 else len(page)
                continue
            if page.startswith(("<!", "<?"), lt):
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else len(page)
                continue
            m = _TAG.match(page, lt)
            end = ends.of(m.end()) if m else -1
            if end < 0:
                text(lt, lt + 1)  # a lone mark
                at = lt + 1
                continue
            at, tag = end, m[2].lower()
            if tag not in INLINE:
                block += 1
            if m[1]:
                if counts.get(tag, 0):
                    while self.tag[open_[-1]] != tag:
                        close()
                    close()
                continue
            if tag in VOID:
                continue
            if tag in NO_P and self.tag[blocks[-1]] == "p":  # an open paragraph ends here, with the inline elements in it
                close_to(blocks[-1])
            if tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
                k = -2 if self.tag[blocks[-1]] == "p" else -1
                if self.tag[blocks[k]] == tag:
                    close_to(blocks[k])
            attributes = page[m.end() : end - 1]
            named = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)).lower() if "=" in attributes else ""
            e, over = len(self.parent), blocks[-1]
            self.parent.append(open_[-1])
            self.tag.append(tag)
            inline = tag in INLINE
            self.path.append(self.path[over] if inline else paths.setdefault((self.path[over], tag, named), len(paths) + 1))
            self.named.append(WHOLLY if tag == "form" else NONE if tag in ("html", "body", "article", "main") else furniture_name(named))
            self.unseen.append(tag in NEVER or bool(attributes) and tag not in ("html", "body") and bool(_HIDDEN.search(attributes)))
            self.article.append(self.article[open_[-1]] or tag in ("article", "main"))
            self.block_of.append(self.block_of[open_[-1]] if inline else e)
            open_.append(e)
            counts[tag] = counts.get(tag, 0) + 1
            hidden += self.unseen[e]
            links += tag == "a"
            if not inline:
                blocks.append(e)
            if tag in RAW:
                m = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = m.start() if m else len(page)

    def sums(self, weights: dict[int, float]) -> np.ndarray:
        """For each element, what all that is in it weighs."""
        total = np.zeros(len(self.parent))
        for e, w in weights.items():
            total[e] += w
        for e in range(len(self.parent) - 1, 0, -1):
            total[self.parent[e]] += total[e]
        return total


def _furniture(tree: Tree, sizes: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """Elements with a furniture name, and all in them, but for wrappers of the page's text; and those in an article whose name has other words too.

    A wrapper holds half of the page's text or more, does not stand in an article or main, and has no article beside it.
    """
    size = tree.sums(sizes)
    articles = tree.sums({e: n for e, n in sizes.items() if tree.article[e]})
    hit, maybe = np.zeros(len(size), bool), np.zeros(len(size), bool)
    for e in np.flatnonzero(np.array(tree.named)):
        within = tree.article[tree.parent[e]]
        maybe[e] = within and tree.named[e] == PARTLY
        hit[e] = not maybe[e] and (within or size[e] < size[0] / 2 or articles[e] < articles[0])
    for e in range(1, len(hit)):
        hit[e] |= hit[tree.parent[e]]
        maybe[e] |= maybe[tree.parent[e]]
    return hit, maybe


def blocks_of(tree: Tree) -> list[list]:
    """Runs of text nodes in one block of one element: element, path, text, characters in links."""
    out: list[list] = []
    before = None
    for e, block, text, linked in tree.texts:
        at = (tree.block_of[e], block)
        if at != before:
            out.append([at[0], tree.path[e], [], 0])
            before = at
        out[-1][2].append(text)
        out[-1][3] += linked * len("".join(text.split()))
    for b in out:
        b[2] = " ".join("".join(b[2]).split())
    return [b for b in out if b[2]]


def scores(tree: Tree, blocks: list[list]) -> tuple[np.ndarray, float]:
    """A score for each block and the threshold. It is the score of its path, so that a path's blocks stand or fall together
    but for where they stand.

    A path's own ratio: text for each node, times one more than its punctuation, times its share outside links. The
    threshold is LEAST times the mean of the ratios, weighted by text. Paths beyond CORE times the mean say where the content is: the deepest
    element with nearly all their text and the headings and paragraphs that lead up to it, or an article. There the ratio,
    smoothed over the blocks in order, counts as the mean at least, and in an article links count as text. A furniture name
    leaves a path little of its score; in an article, one with other words too does so only where the ratio is low as it is.
    """
    names, of = np.unique([b[1] for b in blocks], return_inverse=True)
    size = np.array([len(b[2]) for b in blocks], float)
    sums = lambda x: np.bincount(of, weights=x, minlength=len(names))
    text, count = sums(size), np.bincount(of, minlength=len(names))
    solid = [len("".join(b[2].split())) for b in blocks]
    free = (1 - sums([b[3] for b in blocks]) / sums(solid))[of]
    own = ((text / count) * (1 + sums([len(_PUNCTUATION.findall(b[2])) for b in blocks]) / count))[of]
    hit, maybe = (x[[b[0] for b in blocks]] for x in _furniture(tree, _by_element(blocks, size)))
    weak = own * free < CORE * (own * free * size).sum() / size.sum()
    label = np.where(hit | maybe & weak, NAMED_WEIGHT, 1.0)
    ratio = own * free * label
    mean = float((ratio * size).sum() / size.sum())
    core = ratio >= mean * CORE
    held = tree.sums(_by_element(blocks, size * core))
    article = np.array([tree.article[b[0]] for b in blocks])
    kernel = np.array([1.0, 2.0, 1.0])
    smooth = (np.convolve(own, kernel) / np.convolve(np.ones(len(own)), kernel))[1:-1]
    smooth = (sums(smooth) / count)[of]
    if (size * core * article).sum() >= (size * core).sum() / 2:
        inside, free = article, np.where(article, 1.0, free)
    else:
        root = max((e for e in range(len(held)) if held[e] >= HELD * held[0] and tree.tag[e] not in _LEAVES), default=0)
        under = np.zeros(len(held), bool)
        under[root] = True
        for e in range(root + 1, len(held)):
            under[e] = under[tree.parent[e]]
        for e in _leads(tree, root):
            under[e] = True
        inside = under[[b[0] for b in blocks]]
    return np.where(inside, np.maximum(smooth, mean) * free * label, ratio), mean * LEAST


def _leads(tree: Tree, root: int) -> list[int]:
    """Headings and paragraphs that stand right before an element, beside it."""
    beside = [e for e in range(1, root) if tree.parent[e] == tree.parent[root] and tree.block_of[e] == e] if root else []
    out = []
    while beside and tree.tag[beside[-1]] in _LEADS and not tree.unseen[beside[-1]]:
        out.append(beside.pop())
    return out


def _by_element(blocks: list[list], size: np.ndarray) -> dict[int, float]:
    out: dict[int, float] = {}
    for b, n in zip(blocks, size.tolist()):
        out[b[0]] = out.get(b[0], 0.0) + n
    return out


def main_text(page: str | None) -> str:
    """White space in a block is one space; chosen blocks are joined in page order by one space."""
    tree = Tree(page or "")
    blocks = blocks_of(tree)
    if not blocks:
        return ""
    score, least = scores(tree, blocks)
    return " ".join(b[2] for b, s in zip(blocks, score) if s >= least)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) for each row of ``pages``; null or empty html has empty text.

    A page is read whole, however long and however badly nested. Left out are elements that never hold content, such as
    scripts, forms' parts, menus, headers and footers, and the nodes of paths whose score is under the threshold: lists of
    links beside the content, elements with a furniture name that aren't wrappers, and short texts outside the content's
    element. Rows that repeat are answered one by one; other columns are not read. No rows give no rows.
    """
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html", 4 << 20):
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
