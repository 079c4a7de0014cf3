"""Main text of web pages by tag-path ratios (operator 13).

A page is read into blocks of text, each with its root-to-leaf path of tags (with
class words; inline tags leave no trace).  For every path of a page the text
length, the punctuation and the linked text are summed over its blocks.  A path's
ratio is its unlinked text per block; it is fused with punctuation per block and
with what the path's tags say (``article`` and ``main`` speak for content), and
smoothed over the tree of paths: every path takes part with a weight that falls
with each step between the two paths, so headings and short paragraphs share in
their neighbours' ratio.  Paths whose smoothed ratio reaches a share of the best
are content.  The outermost article (else main) element that holds nearly all
of their text, or without one the deepest such element below the body, makes all
its other blocks content too, so short parts of an article are kept.

Elements that are no article by their kind (menus, page headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments) have no
paths: they are told by tag, role and whole words of class and id.

Reading is linear in the page: one pass over the tags with the usual rules for
tags that close others, two passes over the tree of paths.

Defined results: null and empty pages, and pages without content, give an empty
text; pages of any length are read whole; a page cut off anywhere is read as far
as it goes (an unfinished tag at its end is no text); every row is judged by
itself, so repeated rows and ties need no rule; an empty table gives no rows; other
columns are not read.
"""
from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from pairforge.llm._arrow import map_texts

# fixed values: the HTML standard's kinds of elements
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
#: what an opening tag closes, and the elements that shield what is outside of them
PARAGRAPH_ENDS = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
                           "h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
          "optgroup": ("option", "optgroup"), "thead": ("td", "th", "tr", "thead", "tbody"), "tbody": ("td", "th", "tr", "thead", "tbody"),
          "tfoot": ("td", "th", "tr", "tbody"), **{f"h{i}": tuple(f"h{j}" for j in range(1, 7)) for i in range(1, 7)}}
SHIELDS = frozenset("applet caption html table td th marquee object template button".split())
SHIELDS_OF = {"li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "option": frozenset(["select"]),
              "optgroup": frozenset(["select"]), **{t: frozenset(["table"]) for t in ("tr", "td", "th", "thead", "tbody", "tfoot")}}

# fixed values: elements that hold no article
OUT_TAGS = frozenset("head script style noscript template nav footer aside form button select textarea iframe object svg math canvas dialog menu noembed "
                     "noframes datalist audio video map search title xmp applet frameset rp".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist".split())
OUT_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox banner banners sponsor sponsors sponsored promo "
                      "promos promotion cookie cookies cookiebar consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription "
                      "signup login sidebar sidebars aside rail widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs crumbs pager pagination "
                      "toolbar topbar footer masthead copyright share sharing social related recommended recommendations trending comment comments commentlist "
                      "disqus reply replies respond discussion".split())
NOT_WORDS = frozenset("with has no without".split())
#: of a nested article only these words say that it is none
ARTICLE_OUT = frozenset("comment comments reply replies related recommended ad advert sponsored promo".split())
CONTENT_WORDS = frozenset("article articlebody content entry main post story maincontent".split())

#: the weight of a path falls by this with every step between two paths
DECAY = 0.3
#: share of the best smoothed ratio from which on a path is content
THRESHOLD = 0.2
#: share of the content's text that an element holds to be taken whole
HOLDS = 0.9
#: what an article element adds to the ratio of its paths
CONTENT_PRIOR = 10.0
PUNCTUATION = re.compile(r"[.,;:!?…¡¿、。，！？；：،؛؟।]")

TOKEN = re.compile(
    r"<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[\s/]*+(?>[^\s/>=][^\s/>=]*+|=)(?>\s*+=\s*+(?>\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?)?)*+)[\s/]*+(?:>|(?P<cut>\Z))"
    r"|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+(?:>|\Z)|<\Z")
ATTR = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _words(value: str) -> list[str]:
    return [w.lower() for w in WORD.findall(value)]


def _said(name: str, attrs: str) -> tuple[str | None, str]:
    """(why the element is no article, or None; its label in the path)."""
    words: list[str] = []
    role, hidden = "", False
    if attrs:
        for key, a, b, c in ATTR.findall(attrs):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                words += _words(value)
            elif key == "role":
                role = value.strip().lower()
            elif key == "hidden" or key == "aria-hidden" and value == "true" or \
                    key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = True
    label = ".".join([name, *words]) if words and name not in INLINE else name
    if name in ("html", "body"):
        return None, name
    if name in OUT_TAGS:
        return name, label
    if hidden or role in OUT_ROLES:
        return "role", label
    if name == "main" or role == "main":
        return None, label
    bad = ARTICLE_OUT if name == "article" else OUT_WORDS
    if any(w in bad and (i == 0 or words[i - 1] not in NOT_WORDS) for i, w in enumerate(words)):
        return "word", label
    if name == "header" or name != "article" and "header" in words:
        return "header", label
    return None, label


class Page:
    """Blocks of a page and its tree of paths: ``parent``, ``label`` of each path, ``blocks`` of (path, text, linked letters)."""

    def __init__(self, html: str):
        self.parent, self.label, self.blocks = [-1], [""], []
        self._path_of: dict[tuple[int, str], int] = {}
        # an open element: name, path, why it is out, whether it is in an article
        self._open: list[tuple[str, int, str | None, bool]] = [("", 0, None, False)]
        self._at: dict[str, list[int]] = {}
        self._text: list[str] = []
        self._linked = 0
        self._read(html)

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.blocks.append((self._open[-1][1], text, self._linked))
        self._text, self._linked = [], 0

    def _pop_to(self, i: int) -> None:
        if any(x[0] not in INLINE for x in self._open[i:]):
            self._flush()
        for name, *_ in self._open[i:]:
            self._at[name].pop()
        del self._open[i:]

    def _last(self, names) -> int:
        return max((self._at[n][-1] for n in names if self._at.get(n)), default=0)

    def _close(self, names, shields) -> None:
        """Close the innermost element of each of these names that nothing shields."""
        wall = self._last(shields)
        inside = [self._at[n][-1] for n in names if self._at.get(n) and self._at[n][-1] > wall]
        if inside:
            self._pop_to(min(inside))

    def _push(self, name: str, attrs: str) -> None:
        _, path, out, article = self._open[-1]
        why, label = _said(name, attrs)
        if out is None and why == "header" and article:
            why = "heading"  # an article's own header: only its headings count
        if name in ("article", "main") and why is None and out in ("form", "nav", "header", "heading"):
            out = None
        if out == "heading" and re.fullmatch("h[1-6]", name):
            out = None
        if out is None:
            out = why
        if name not in INLINE:
            key = (path, label)
            if key not in self._path_of:
                self._path_of[key] = len(self.parent)
                self.parent.append(path)
                self.label.append(label)
            path = self._path_of[key]
        self._at.setdefault(name, []).append(len(self._open))
        self._open.append((name, path, out, article or name in ("article", "main")))

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = TOKEN.search(html, at)
            stop = m.start() if m else n
            if stop > at and self._open[-1][2] is None:
                text = unescape(html[at:stop])
                self._text.append(text)
                if self._at.get("a"):
                    self._linked += len(text.strip())
            if not m:
                break
            at = m.end()
            name = m["name"]
            if name is None or m["cut"] is not None:
                continue
            name = name.lower()
            if m["close"]:
                where = self._at.get(name)
                wall = 0 if name in SHIELDS else self._last(SHIELDS)
                if name in INLINE:
                    # an inline tag closes no block
                    if where and where[-1] > max(wall, self._block()):
                        self._pop_to(where[-1])
                elif where and where[-1] > (0 if name in ("body", "table") else wall):
                    self._pop_to(where[-1])
                elif name in ("p", "br"):
                    self._flush()
                continue
            if name in PARAGRAPH_ENDS:
                self._close(("p",), SHIELDS)
            if name in CLOSES:
                self._close(CLOSES[name], SHIELDS_OF.get(name, SHIELDS | {"div", "section", "article"}))
            if name not in INLINE and name not in ("br", "wbr", "img"):
                self._flush()
            if name in VOID:
                if name == "br":
                    self._text.append(" ")
                continue
            if name in RAW:  # whatever stands up to its closing tag is no markup
                end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
                at = end.start() if end else n
                if end:
                    at = html.find(">", at) + 1 or n
                continue
            self._push(name, m["attrs"])
        self._flush()

    def _block(self) -> int:
        """Place of the innermost open element that is not inline."""
        i = len(self._open) - 1
        while i > 0 and self._open[i][0] in INLINE:
            i -= 1
        return i


def ratios(page: Page) -> list[float]:
    """The fused and smoothed ratio of every path (0 for paths without text)."""
    n = len(page.parent)
    chars, marks, linked, count = ([0] * n for _ in range(4))
    for path, text, links in page.blocks:
        chars[path] += len(text)
        marks[path] += len(PUNCTUATION.findall(text))
        linked[path] += links
        count[path] += 1
    prior = [0.0] * n
    for i in range(1, n):
        name, *words = page.label[i].split(".")
        prior[i] = max(prior[page.parent[i]], CONTENT_PRIOR if name in ("article", "main") else
                       CONTENT_PRIOR / 2 if name not in ("html", "body") and CONTENT_WORDS & set(words) else 0.0)
    top, mass = [0.0] * n, [float(c) for c in chars]
    for i in range(n):
        if count[i]:
            own = max(chars[i] - linked[i], 0) / count[i] * (1 + marks[i] / count[i]) * (1 + prior[i])
            top[i] = own * chars[i]
    # weights fall with the steps between paths: sums from below, then from above
    for values in (top, mass):
        for i in range(n - 1, 0, -1):
            values[page.parent[i]] += DECAY * values[i]
        for i in range(1, n):
            values[i] += DECAY * (values[page.parent[i]] - DECAY * values[i])
    return [top[i] / mass[i] if count[i] else 0.0 for i in range(n)]


def main_blocks(page: Page) -> list[bool]:
    """Whether each block is content."""
    if not page.blocks:
        return []
    n = len(page.parent)
    smooth = ratios(page)
    least = THRESHOLD * max(smooth)
    content = [s > 0 and s >= least for s in smooth]
    # the deepest element below the body that holds nearly all content is taken whole
    held = [0] * n
    for path, text, _ in page.blocks:
        held[path] += len(text) if content[path] else 0
    for i in range(n - 1, 0, -1):
        held[page.parent[i]] += held[i]
    inner = [i for i in range(1, n) if page.label[i] not in ("html", "body") and held[i] >= HOLDS * held[0] > 0]
    # a leaf is no container of others: its parent's other blocks belong to it
    leaf = [True] * n
    for i in range(1, n):
        leaf[page.parent[i]] = False
    holders = [i for i in inner if not leaf[i]]
    for kind in ({"article"}, {"main"}, CONTENT_WORDS):
        named = [i for i in inner if kind & set(page.label[i].split(".")[0 if len(kind) == 1 else 1:])]
        if named:
            holders = named[:1]
            break
    taken, under = list(content), [False] * n
    for i in range(1, n):
        if holders and (i == holders[-1] or under[page.parent[i]]):
            under[i] = taken[i] = True
    return [taken[path] for path, _, _ in page.blocks]


def main_text(html: str | None) -> str:
    page = Page(html or "")
    return "\n".join(text for (_, text, _), keep in zip(page.blocks, main_blocks(page)) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id``, the main ``text`` and its ``n_chars`` of every row."""
    def run(html: pa.Array) -> list[pa.Array]:
        texts = [main_text(h) for h in html.to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
    return map_texts(pages, run, "text string, n_chars bigint", id_col, html_col)
