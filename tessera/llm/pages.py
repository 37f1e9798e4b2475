"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. A block has its words, the share of them in links, whether it stands in
a heading or a list, and what the open elements around it are called; with the same of the block before and the one
after, these are the features of a decision tree, which is trained on a small labelled table (`EXAMPLES`). The text of
the blocks that it takes is joined in page order.

Null html counts as empty and gives the empty text; so do pages without such blocks. Broken markup is read as browsers
do in the main: unclosed elements end with those around them. Repeated rows are returned each; an empty table gives an
empty table. Whole pages are read, however long.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of HTML: elements that are laid out as blocks, that never have an end tag, and whose content is no text.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = ("script", "style", "noscript", "template", "textarea", "select", "svg", "math", "iframe", "object", "canvas", "title", "button", "datalist", "audio", "video")
#: Elements that another one of the same kind, or of those with it, ends.
SIBLINGS = {x: g for g in (("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",)) for x in g}
#: Block elements whose start ends an open paragraph.
ENDS_P = BLOCK - {"br", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "option", "title"}

# Names by which pages mark their parts, in elements, classes, ids and roles.
SIDE_TAGS = frozenset("nav aside footer header form menu dialog fieldset head".split())
SIDE_NAMES = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner topbar footer foot colophon sidebar side aside widget widgets related recommended ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert disclaimer comment comments commentlist disqus respond reply replies discussion share sharing social subscribe newsletter signup login search searchbox form popup modal overlay toolbar pagination pager tags tagcloud copyright legal skip contentinfo complementary".split())
MAIN_TAGS = frozenset("article main".split())
MAIN_NAMES = frozenset("article post entry content main story body text".split())

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)>|[!?/][^>]*>)""", re.S)
_CUT_OFF = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>", re.I) for x in HIDDEN}


class Block:
    """A text, its words, those of them in links, and marks of the elements around it."""

    __slots__ = ("heading", "item", "linked", "main", "side", "text", "words")

    def __init__(self, text: str, words: int, linked: int, heading: bool, item: bool, side: bool, main: bool):
        self.text, self.words, self.linked, self.heading, self.item, self.side, self.main = text, words, linked, heading, item, side, main


def _marks(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is called like a side part, like the main part, or not shown."""
    side, main, hidden = tag in SIDE_TAGS, tag in MAIN_TAGS, False
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true" and tag != "a"):
                hidden = True
            elif key == "style":
                hidden |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
            elif key != "aria-hidden":
                names = {x.lower() for x in _NAME.findall(value)}
                # "with-sidebar" is around the main part, "entry-header" holds its title
                apart = names & SIDE_NAMES and not names & {"with", "has", "no"} and not ("header" in names and names & MAIN_NAMES)
                side |= bool(apart) and tag not in ("body", "html")
                main |= bool(names & MAIN_NAMES)
    return side, main, hidden


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, and side, main, hidden with what is around
    text: list[str] = []
    linked: list[str] = []
    links = 0
    at, end = 0, len(page)

    def close() -> None:
        nonlocal text, linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                tags = {x[0] for x in stack}
                _, side, main, hidden = stack[-1] if stack else ("", False, False, False)
                if not hidden:
                    out.append(Block(whole, whole.count(" ") + 1, len("".join(linked).split()), bool(tags & {"h1", "h2", "h3", "h4", "h5", "h6"}), bool(tags & {"li", "dt", "dd", "option"}), side, main))
            text, linked = [], []

    def pop(k: int) -> None:
        nonlocal links
        links -= sum(x[0] == "a" for x in stack[k:])
        del stack[k:]

    while at < end:
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece and not m:
            piece = _CUT_OFF.sub("", piece)  # a tag that the page's end cuts off
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if links > 0:
                linked.append(piece + " ")
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if stack[k][0] in ("article", "main", "body", "td", "th") and tag not in BLOCK | {"article"}:
                    break
            continue
        if tag in _RAW_END:
            if not m[3].rstrip().endswith("/") or tag in ("script", "style", "title"):
                ended = _RAW_END[tag].search(page, at)
                at = ended.end() if ended else end if tag in ("script", "style") else at
            continue
        if tag in BLOCK:
            close()
            if tag in ENDS_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        pop(k)
                        break
                    if stack[k][0] in ENDS_P:
                        break
            if tag in SIBLINGS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in SIBLINGS[tag]:
                        pop(k)
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "tbody", "select", "menu"):
                        break
        if tag in VOID:
            continue
        side, main, hidden = _marks(tag, m[3])
        around = stack[-1] if stack else ("", False, False, False)
        # a part's own header, such as an article's, is no page header
        if tag == "header" and around[2] and not around[1]:
            side = False
        stack.append((tag, around[1] or side, around[2] or main, around[3] or hidden))
        links += tag == "a"
    close()
    return out


def _features(found: list[Block]) -> np.ndarray:
    """Of each block: words, link density, heading, item, side, main, and the first two and the side of its neighbours."""
    if not found:
        return np.empty((0, 13))
    own = np.array([(b.words, b.linked / b.words, b.heading, b.item, b.side, b.main) for b in found], float)
    edge = np.zeros((1, 6))
    padded = np.concatenate([edge, own, edge])
    main = np.full((len(found), 1), own[:, 5].any(), float)
    return np.concatenate([own, padded[:-2, [0, 1, 4]], padded[2:, [0, 1, 4]], main], axis=1)


#: The labelled table: pages whose blocks are marked + for main text or - for the rest, in page order.
EXAMPLES = (
    ("-----++++--", '<html><head><title>x</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/a">News</a></li><li><a href="/b">About us</a></li></ul></nav><div class="ad">Buy one now and get another one free today only</div><div class="notice">We use cookies to give you the best of our site and to measure it</div><article><h1>A title of words</h1><p>The first part of the story has a number of words that tell what has happened here.</p><p>Short.</p><p>Another one, with a <a href="/x">link inside</a> of the sentence that goes on and on for a while.</p></article><aside>Related stories that may be read as well, with many words in them to see here</aside><footer>Copyright of the site and its owners, all rights reserved</footer></body></html>'),
    ("--++--", '<body><div id="header"><a href="/">Site</a></div><div class="menu"><a href="/1">One</a> <a href="/2">Two</a></div><div class="post"><h2>On things</h2><p>It was said that things would be as they are and so they were in the end, more or less.</p></div><div class="comments"><p>Great post, I have read it twice and still think that you are quite right about it.</p></div><form>Your mail address here to get news of all that we do each week</form></body>'),
    ("-+++-", '<body><p><a href="/">Home</a> <a href="/m">More</a></p><p>No frame marks this text, but it is long enough to be what the page is about, as anyone can see who reads it in full and to its end.</p><p>It goes on here with still more words, none of which is a link, so that all of it may be taken for the main text.</p><p>And this is the last part of it, again with a good number of words in a row that make up sentences.</p><p><a href="/i">Imprint</a> <a href="/p">Privacy</a></p></body>'),
    ("-++++-", '<body><header>The daily paper of this town and all others near it</header><main><h1>Lists</h1><ul><li>One thing</li><li>Another</li></ul><p>End.</p></main><footer>Contact</footer></body>'),
    ("+-+", '<article><p>What begins before an advert is as long as what follows after it in most of the pages.</p><div class="advert">An offer that stands right in the middle of the text and has a lot of words</div><p>The text then goes on.</p></article>'),
    ("++-", '<article><h1>See <a href="/t">the title as a link</a></h1><p><a href="/u">All of this is linked</a></p><div class="share"><a href="/s">Share</a></div></article>'),
    ("-", '<body><a href="/1">Just a link</a></body>'),
    ("--+-", '<body><ul><li>Log in</li><li>Help</li></ul><div>A story without any marks that has more than a dozen words in it, and so it has to be the text of this page.</div><div>Back to top</div></body>'),
    ("-+-", '<body><div class="sidebar">Text at the side, which goes on for rather long and has no links in it at all, but is no main text</div><div class="content">Short text</div><section class="comments">A comment of a reader with more words than the text has, as is often so</section></body>'),
)


class Tree:
    """A decision tree that splits by Gini impurity until leaves are pure or nothing tells their rows apart."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.feature, self.least, self.below, self.above = -1, 0.0, None, None
        self.label = bool(y.mean() >= 0.5) if len(y) else False
        if depth == 0 or len(set(y.tolist())) < 2:
            return
        best = (np.inf, -1, 0.0)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                low = x[:, f] <= cut
                impure = sum(2 * len(part) * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
                if impure < best[0] - 1e-12:
                    best = (impure, f, cut)
        if best[1] < 0:
            return
        _, self.feature, self.least = best
        low = x[:, self.feature] <= self.least
        self.below, self.above = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.label)
        low, out = x[:, self.feature] <= self.least, np.empty(len(x), bool)
        out[low], out[~low] = self.below.predict(x[low]), self.above.predict(x[~low])
        return out


def trained(examples: tuple[tuple[str, str], ...] = EXAMPLES) -> Tree:
    x, y = [], []
    for labels, page in examples:
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError(f"{len(labels)} labels for {[b.text for b in found]}")
        x.append(_features(found))
        y += [c == "+" for c in labels]
    return Tree(np.concatenate(x), np.array(y, float))


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return " ".join(b.text for b, taken in zip(found, tree.predict(_features(found)), strict=True) if taken)


def extract(df: DataFrame, column: str = "html", out: str = "main_text", tree: Tree | None = None) -> DataFrame:
    """df with the main text of each page, in place of any column `out`."""
    tree = tree or trained()
    schema = T.StructType([f for f in df.schema if f.name != out] + [T.StructField(out, T.StringType(), False)])
    keep = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = pa.array([main_text(x.as_py(), tree) for x in part.column(column)], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], texts], names=[*keep, out])

    return df.mapInArrow(run, schema)
