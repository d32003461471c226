"""Main text of web pages by composite text density.

The page becomes a tree. Only what no reader sees goes beforehand: the head, scripts, styles, templates, hidden elements and comments of
the markup. For each element, with C characters, T tags, LC link characters and LT link tags inside it, and LCb and Cb of the body,

    density = C / T * log(C / LC * T / LT) / log(1 + log(C / (C - LC) * LC + LCb / Cb * C + e))

(a zero below a fraction counts as one; the 1 in the last logarithm keeps it from zero on pages without links). Links are the adjustment, and
so are marks: the text of an element whose kind (nav, footer, aside, form, ...) or name (class, id or role words) says that it isn't the article counts as link
text, so that its density is zero. Of the pages of the test data, density finds the same text on nine of ten without any marks; they decide
where an advert or a footer is as dense as a short article.

The density sum of a block element is that of the densities of its block children, and of its own run of text as one more child. The
node of the largest sum is the article's; the threshold is the least density on the path from it up to the body, which is not part of it, as it
holds all the rest. Every node below the body whose density reaches the threshold gives the node of the largest sum in its subtree, whole but
for marked parts of it whose density is zero. Where the best node is the body itself, its children that reach the body's density give theirs.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, text_of

# Kinds of elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br-block caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption legend optgroup option tbody td tfoot th thead tr".split())
# Start tag -> open elements that it ends, and where the search for them stops.
IMPLIED = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"),
    "tr": ("tr td th", "table"), "td": ("td th", "table tr"), "th": ("td th", "table tr"), "tbody": ("tbody thead tfoot tr td th", "table"),
}
IMPLIED = {tag: (which.split(), stop.split()) for tag, (which, stop) in IMPLIED.items()}
P_STOPS = ["table", "td", "th", "button", "caption", "object"]
#: End tags of other elements don't reach beyond these.
CELLS = ["table", "td", "th", "caption"]
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption body html".split())

#: Elements that no reader sees as text.
UNSEEN = frozenset("head script style noscript template title iframe object embed svg math canvas audio video map xmp noembed noframes datalist".split())
#: Elements that mark their text as something else than the article.
MARKED_TAGS = frozenset("nav header footer aside form button select textarea input label fieldset dialog menu search".split())
#: Of these, the ones that may stand around an article.
AROUND = frozenset("form header fieldset label".split())
#: Words of class, id or role that mark as well.
MARKED_WORDS = frozenset(
    "ad ads adsbygoogle adsense adv advert adverts advertisement advertising alert banner banners bottombar breadcrumb breadcrumbs colophon comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog disclaimer "
    "disqus dropdown footer gdpr header hidden login mainnav masthead megamenu menu menus modal nav navbar navigation newsletter notice notices notification outbrain pagefooter pageheader pager pagination paywall popup promo promoted promotion promotions "
    "recommendations recommended register related replies respond search share sharing sidebar sidebars sidenav signup skyscraper social sponsor sponsored sponsors subnav subscribe subscription taboola tagcloud teaser toolbar topbar topnav widget widgets".split()
)
#: Names of elements that hold reader comments, even where these are articles.
COMMENT_NAMES = frozenset("comment comments comment-list commentlist comment-section comments-section comments-area comment-thread disqus disqus_thread replies respond reader-comments user-comments".split())

_OPENING = re.compile(r"<(?=/?[a-zA-Z]|[!?])")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.IGNORECASE) for tag in RAW}
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

SEEN, NAMED, MARKED, COMMENTS, GONE = range(5)


def _mark(tag: str, attributes: str) -> int:
    """GONE where it is never seen; else what marks it: its names, its kind, names of reader comments, or nothing."""
    if tag in UNSEEN:
        return GONE
    if not attributes or tag in ("html", "body", "main"):
        return MARKED if tag in MARKED_TAGS else SEEN
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return GONE
    if tag in MARKED_TAGS:
        return MARKED
    if not COMMENT_NAMES.isdisjoint(f"{found.get('class', '')} {found.get('id', '')}".lower().split()):
        return COMMENTS
    names = _CAMEL.sub(" ", " ".join(found.get(x, "") for x in ("class", "id", "role"))).lower()
    return NAMED if tag != "article" and not MARKED_WORDS.isdisjoint(_WORD.findall(names)) else SEEN


class _Tree:
    """Nodes in page order with parent, tag and mark; texts as (node, block number, decoded text). Parsing is linear in the page."""

    def __init__(self, page: str):
        self.parent, self.tag, self.mark = [-1], ["#root"], [SEEN]
        self.texts: list[tuple[int, int, str]] = []
        self.open = [0]
        self.depths: dict[str, list[int]] = defaultdict(list)  # where in open the elements of a tag are
        self.block = 0
        at, n, unpaired, endless = 0, len(page), False, set()
        while at < n:
            found = _OPENING.search(page, at)
            if not found:
                self._text(page[at:])
                return
            start = found.start()
            if page[start + 1] in "!?":
                self._text(page[at:start])
                comment = page.startswith("!--", start + 1)
                end = page.find("-->" if comment else ">", start + (4 if comment else 2))
                at = n if end < 0 else end + (3 if comment else 1)
                continue
            name = _NAME.match(page, start + 1)
            self._text(page[at:start])
            end = None if unpaired else _REST.match(page, name.end())
            if end:
                at = end.end()
            else:  # quotes that never end, from here on: tags end at the next > instead; without one the page cuts this tag off
                unpaired = True
                at = page.find(">", name.end()) + 1
                if not at:
                    return
            tag = name[2].lower()
            if name[1]:
                self._end(tag)
            else:
                self._start(tag, page[name.end() : at - 1])
                if tag in RAW and tag not in endless:
                    end = _RAW_END[tag].search(page, at)
                    if end:
                        at = end.end()
                    elif tag in ("title", "script", "style"):
                        return
                    else:
                        endless.add(tag)
                    self._pop_to(self.depths[tag][-1])

    def _text(self, piece: str) -> None:
        if piece:
            self.texts.append((self.open[-1], self.block, html.unescape(piece)))

    def _pop_to(self, depth: int) -> None:
        for node in self.open[depth:]:
            self.depths[self.tag[node]].pop()
        del self.open[depth:]

    def _deepest(self, tags: list[str]) -> int:
        return max([self.depths[x][-1] for x in tags if self.depths[x]], default=0)

    def _close(self, which: list[str], stops: list[str]) -> None:
        stop = self._deepest(stops)
        while (depth := self._deepest(which)) > stop:
            self._pop_to(depth)

    def _end(self, tag: str) -> None:
        if tag == "br":
            self.texts.append((self.open[-1], self.block, " "))
        elif self.depths[tag] and (tag in TABLE_PARTS or self.depths[tag][-1] > self._deepest(CELLS)):
            self._pop_to(self.depths[tag][-1])
        if tag in BLOCK:
            self.block += 1

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.texts.append((self.open[-1], self.block, " "))
        if tag in ("html", "body") and self.depths[tag]:
            return
        if tag in CLOSES_P and self.depths["p"]:
            self._close(["p"], P_STOPS)
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if tag in BLOCK:
            self.block += 1
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.mark.append(_mark(tag, attributes))
        # a slash at its end means nothing on elements of HTML
        if tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "math", "path")):
            self.depths[tag].append(len(self.open))
            self.open.append(len(self.tag) - 1)


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density; share: link characters of the body, of all of its characters."""
    if not chars:
        return 0.0
    t, lt, lc = tags or 1, link_tags or 1, link_chars or 1
    return chars / t * log(max(1.0, chars / lc * t / lt)) / log(1 + log(chars / (chars - link_chars or 1) * link_chars + share * chars + e))


def main_text(page: str) -> str:
    """The blocks of the main text of a page, joined by newlines; empty if there is none."""
    tree = _Tree(page)
    parent, tag, mark = tree.parent, tree.tag, tree.mark
    n = len(tag)
    holds = [x in ("article", "main") for x in tag]
    for i in range(n - 1, 0, -1):
        holds[parent[i]] |= holds[i]
    gone, marked, link, box = [False] * n, [False] * n, [False] * n, [0] * n  # box: the nearest block
    for i in range(1, n):
        up = parent[i]
        gone[i] = gone[up] or mark[i] == GONE
        marked[i] = marked[up] or mark[i] == COMMENTS or mark[i] == NAMED and not holds[i] or mark[i] == MARKED and not (tag[i] in AROUND and holds[i])
        link[i] = marked[i] or link[up] or tag[i] == "a"
        box[i] = i if tag[i] in BLOCK else box[up]
    pieces = [(i, block, x) for i, block, x in tree.texts if not gone[i]]
    # of each block: characters, link characters, tags, link tags of its own run of text, then of all of it
    own = [[0] * n for _ in range(4)]
    for i, _, x in pieces:
        size = len("".join(x.split()))
        own[0][box[i]] += size
        if link[i]:
            own[1][box[i]] += size
    for i in range(1, n):
        if box[i] != i and not gone[i]:
            own[2][box[i]] += 1
            own[3][box[i]] += link[i]
    whole = [x.copy() for x in own]
    blocks = [i for i in range(1, n) if box[i] == i and not gone[i]]
    for i in reversed(blocks):
        up = box[parent[i]]
        for k, x in enumerate(whole):
            x[up] += x[i] + (k == 2) + (k == 3 and link[i])
    body = next((i for i in blocks if tag[i] == "body" and whole[0][i]), 0)
    share = whole[1][body] / (whole[0][body] or 1)
    dense, run, sums = [0.0] * n, [0.0] * n, [0.0] * n
    for i in [0, *blocks]:
        dense[i] = density(*(x[i] for x in (whole[0], whole[2], whole[1], whole[3])), share)
        run[i] = density(*(x[i] for x in (own[0], own[2], own[1], own[3])), share)
        sums[i] += run[i]
        if i:
            sums[box[parent[i]]] += dense[i]
    best = list(range(n))  # by block: the node of the largest density sum in its subtree; the innermost, then the first on ties
    for i in reversed(blocks):
        up = box[parent[i]]
        if best[up] == up and sums[best[i]] >= sums[up] or best[up] != up and sums[best[i]] >= sums[best[up]]:
            best[up] = best[i]
    at = best[body]
    threshold = dense[at]
    while at != body and (at := box[parent[at]]) != body:
        threshold = min(threshold, dense[at])
    keep = [False] * n
    for i in [body, *(x for x in blocks if x > body)]:
        if whole[0][i] and dense[i] >= threshold and (i != body or best[body] != body):
            keep[best[i]] = True
    for i in blocks:
        keep[i] |= keep[box[parent[i]]]
        keep[i] &= not (marked[i] and not dense[i])
    found: dict[int, list[str]] = {}
    keep[body] |= best[body] == body and run[body] >= threshold
    for i, block, x in pieces:
        if keep[box[i]] and (marked[box[i]] or not marked[i]):
            found.setdefault(block, []).append(x)
    return "\n".join(x for x in (" ".join("".join(x).split()) for x in found.values()) if x)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars (code points) of every row.

    A null or empty page gives an empty text. Repeated rows and null ids give rows of their own; an empty table gives none. Columns other
    than the three named aren't read. Pages are parsed whole, one at a time, in time proportional to their length.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), text_of(pages[html_col]).alias("page"))
    kinds = [rows.schema[x].dataType.simpleString() for x in ("id", "url")]
    return map_arrow(rows, run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint").toDF(id_col, url_col, "text", "n_chars")
