"""Main text of HTML pages by a tree-structured graphical model.

The block elements of a page and its text blocks make a tree; each node is content or not. Potentials: how likely the
node's features are for either state, and parent-child potentials for element-element and element-text edges.
Sum-product messages go from the leaves up and back down, in log odds; a text block with a marginal of
one half or more is content. The potentials are counts over labelled pages, which ``labelled_pages`` generates.

Defined cases: null, empty and textless pages have the empty text; unclosed, misnested and cut-off markup is closed where
the next block, the end of an element around it or the page's end closes it; equal rows get equal results; input columns other
than the named ones are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import append_map

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*"[^"]*"|=\s*'[^']*'|=\s*[^\s"'>][^\s>]*+|=(?=\s*>))*+)>
    |<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|data-keep)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements whose insides are never text of the page.
DROPPED = frozenset("script style noscript template iframe object svg math textarea select button datalist canvas audio video title".split())
RAW = frozenset("script style noscript iframe textarea title".split())
#: Start tags that leave an open head open, and end tags that end it.
HEAD_TAGS = frozenset("html head title base basefont bgsound link meta style script noscript template".split())
HEAD_ENDS = frozenset("head body html br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("html body article aside section nav header footer main div form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary center dialog menu search hgroup legend".split())
#: An opening tag that ends an open element of the same group.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
PARENTS_OF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Words in class, id and role attributes, by what they tell.
HINTS = (
    ("ad", r"\bads?\b|advert|banner|promo|sponsor|doubleclick"),
    ("comment", r"comment|discuss|disqus|replies|respond"),
    ("chrome", r"\bnav|menu|breadcrumb|header|masthead|toolbar|footer|copyright|navigation|contentinfo|pagination|pager|skip"),
    ("aside", r"side|aside|related|recommend|share|social|widget|tags?\b|newsletter|subscribe|popular|trending|complementary"),
    ("notice", r"cookie|consent|notice|alert|modal|popup|overlay|gdpr|login|signup|paywall"),
    ("content", r"article|content|post|entry|story|main|body|text"),
)
_HINTS = tuple((k, re.compile(p, re.I)) for k, p in HINTS)
#: Kinds of elements.
KIND = {t: t for t in "article aside section nav header footer main form p li table blockquote pre figure body".split()} | {t: "heading" for t in "h1 h2 h3 h4 h5 h6".split()} | {t: "list" for t in "ul ol dl menu".split()} | {t: "cell" for t in "tr td th caption thead tbody tfoot".split()}


def _hint(attrs: str) -> tuple[str, str | None]:
    names, keep = [], None
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        if name.lower() == "data-keep":
            keep = a or b or c
        else:
            names.append(a or b or c)
    if names:
        joined = " ".join(names)
        for k, p in _HINTS:
            if p.search(joined):
                return k, keep
        return "other", keep
    return "none", keep


class Tree:
    """A page's nodes, parents before children: of each its parent, features, text (None for elements) and label."""

    def __init__(self, page: str | None) -> None:
        self.parent, self.features, self.text, self.keep = [-1], [("root",)], [None], ["0"]
        self._tags = ["#root"]
        stack = [0]
        pieces: list[str] = []
        links, in_link, dropped, in_head = 0, False, None, False
        within: list[str] = []  # blocks open inside the dropped element
        inside: Counter = Counter()  # how many of each
        places: dict[str, list[int]] = {"#root": [0]}  # of each tag, where it is open in the stack
        last: dict[str, int] = {}
        page = page or ""

        def add(tag: str, features: tuple, text: str | None, keep: str | None) -> int:
            self.parent.append(stack[-1])
            self.features.append(features)
            self.text.append(text)
            self.keep.append(self.keep[stack[-1]] if keep is None else keep)
            self._tags.append(tag)
            return len(self.parent) - 1

        def flush() -> None:
            nonlocal links
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                words = text.count(" ") + 1
                size = min(5, words.bit_length())
                density = min(3, int(4 * links / max(1, len(text)) + 0.5))
                add("#text", ("text", f"size{size}", f"links{density}", f"end{text[-1] in '.!?:…'}", f"in_{KIND.get(self._tags[stack[-1]], 'div')}"), text, None)
            pieces.clear()
            links = 0

        def close(to: int) -> None:
            flush()
            for i in stack[to:]:
                places[self._tags[i]].pop()
            del stack[to:]

        def innermost(tags: set[str]) -> int:
            """Where in the stack the last open element of some tags is, or 0."""
            return max((places[x][-1] for x in tags if places.get(x)), default=0)

        def closes(tag: str, at: int) -> bool:
            """Whether the tag's end tag comes at or after a place."""
            if tag not in last:
                last[tag] = max((m.start() for m in re.finditer(f"</{re.escape(tag)}(?=[\\s/>])", page, re.I | re.A)), default=-1)
            return last[tag] >= at

        at = 0
        while at < len(page):
            m = MARKUP.search(page, at)
            stop = m.start() if m else len(page)
            if stop > at and not dropped:
                piece = page[at:stop]
                in_head = in_head and not piece.strip()
                if not in_head:
                    pieces.append(piece)
                    if in_link:
                        links += len(piece)
            if not m:
                break
            at = max(m.end(), stop + 1)
            tag = m["tag"] or m["tag2"]
            if not tag:
                if page.startswith("<![CDATA[", stop) and not dropped and not in_head:
                    pieces.append(page[stop + 9 : m.end() - 3])
                continue
            tag, end = tag.lower(), bool(m["end"] or m["end2"])
            if dropped:
                if end and tag == dropped:
                    dropped = None
                    continue
                if end and inside[tag]:
                    closed = None
                    while closed != tag:
                        closed = within.pop()
                        inside[closed] -= 1
                    continue
                # an open ancestor's end ends it too, and without an end tag of its own the next block
                if end and (tag == "head" and in_head or places.get(tag)) or not end and (tag == "body" and in_head or tag in BLOCKS and not closes(dropped, at)):
                    dropped = None
                else:
                    if not end and tag in BLOCKS:
                        within.append(tag)
                        inside[tag] += 1
                    elif not end and tag in RAW and closes(tag, at):
                        at = re.compile(f"</{tag}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, at).end()
                    continue
            if in_head and (tag in HEAD_ENDS if end else tag not in HEAD_TAGS):
                in_head = False
            if tag == "head":
                in_head = not end and not places.get("body")
                continue
            if tag in DROPPED:
                if not end:
                    attrs = m["attrs"] or m["attrs2"] or ""
                    if tag in RAW:
                        found = re.compile(f"</{tag}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, at)
                        at = found.end() if found else len(page)
                    elif not attrs.endswith("/"):
                        dropped = tag
                        within.clear()
                        inside.clear()
                continue
            if tag not in BLOCKS:
                if tag == "br" or tag == "hr":
                    pieces.append(" ")
                elif tag == "a":
                    in_link = not end
                continue
            if end:
                if i := innermost({tag}):
                    close(i)
                else:
                    flush()
                continue
            in_link = False
            flush()
            if self._tags[stack[-1]] == "p" or tag[0] == "h" and tag[1:].isdigit() and self._tags[stack[-1]][0] == "h" and self._tags[stack[-1]][1:].isdigit():
                close(len(stack) - 1)
            if tag in SIBLINGS:
                if (i := innermost(SIBLINGS[tag])) > innermost(PARENTS_OF[tag]):
                    close(i)
            hint, keep = _hint(m["attrs"] or m["attrs2"] or "")
            # an article's own header may hold its title; a page's doesn't
            inner = "_inside" if tag == "header" and (self._tags[stack[-1]] in ("article", "main") or "hint_content" in self.features[stack[-1]]) else ""
            places.setdefault(tag, []).append(len(stack))
            stack.append(add(tag, ("element", f"tag_{KIND.get(tag, 'div')}{inner}", f"hint_{hint}"), None, keep))
        flush()
        # whether an element's text is mostly links goes with its tag
        size, linked = [0] * len(self.parent), [0.0] * len(self.parent)
        for i in range(len(self.parent) - 1, 0, -1):
            if self.text[i] is not None:
                size[i] = len(self.text[i])
                linked[i] = size[i] * int(self.features[i][2][5:]) / 3
            else:
                self.features[i] = (*self.features[i][:1], f"{self.features[i][1]}{'+' if linked[i] * 2 > size[i] else ''}", *self.features[i][2:])
            size[self.parent[i]] += size[i]
            linked[self.parent[i]] += linked[i]


class Model:
    """Log-odds potentials counted over labelled trees, with one added to each count.

    Features of a node and its neighbours tell partly the same, so the counts of hints, tags and text features are
    raised to powers, chosen by the least log loss on labelled trees.
    """

    def __init__(self, trees: list[Tree]) -> None:
        seen: list[Counter] = [Counter(), Counter()]
        edges: dict[str, list[list[float]]] = {"element": [[1.0, 1.0], [1.0, 1.0]], "text": [[1.0, 1.0], [1.0, 1.0]]}
        for t in trees:
            state = [0] * len(t.parent)
            for i in range(len(t.parent) - 1, 0, -1):  # an element is content if something in it is
                state[i] |= t.keep[i] == "1"
                state[t.parent[i]] |= state[i]
            for i in range(1, len(t.parent)):
                edges[t.features[i][0]][state[t.parent[i]]][state[i]] += 1
                seen[state[i]].update(t.features[i])
                seen[state[i]].update(f"{f[:2]}*{t.features[i][0]}" for f in t.features[i][1:])
        self.weight: dict[str, float] = {}
        for f in seen[0] | seen[1]:
            if "*" not in f and f not in ("text", "element"):
                of = "text" if f"{f[:2]}*text" in seen[0] + seen[1] and f"{f[:2]}*element" not in seen[0] + seen[1] else "element"
                group = f"{f[:2]}*{of}"
                self.weight[f] = math.log((seen[1][f] + 1) / (seen[1][group] + 8)) - math.log((seen[0][f] + 1) / (seen[0][group] + 8))
        self.edge: dict[str, tuple[float, ...]] = {}
        for kind, a in edges.items():
            p = [[x / sum(row) for x in row] for row in a]
            self.edge[kind] = (p[0][0], p[0][1], p[1][0], p[1][1])
        counted, least = self.weight, None
        for hint in (1.0, 2.0, 3.0):
            for tag in (0.3, 0.6, 1.0):
                for text in (0.1, 0.2, 0.4, 0.7):
                    scale = {"hint": hint, "tag_": tag}
                    self.weight = {f: w * scale.get(f[:4], text) for f, w in counted.items()}
                    loss = sum(math.log1p(math.exp(max(-40.0, min(40.0, -o if k == "1" else o)))) for t in trees[::3] for o, k, x in zip(self.marginals(t), t.keep, t.text, strict=True) if x is not None)
                    if least is None or loss < least[0]:
                        least = loss, self.weight
        self.weight = least[1] if least else counted

    def marginals(self, t: Tree) -> list[float]:
        """Log odds of content for every node: messages up, then down."""
        n = len(t.parent)
        up = [sum(self.weight.get(f, 0.0) for f in fs[1:]) for fs in t.features]
        sent = [0.0] * n
        exp, log = math.exp, math.log
        for i in range(n - 1, 0, -1):
            p00, p01, p10, p11 = self.edge[t.features[i][0]]
            b = exp(max(-40.0, min(40.0, up[i])))
            sent[i] = log((p11 * b + p10) / (p01 * b + p00))
            up[t.parent[i]] += sent[i]
        full = up[:]
        full[0] = 40.0  # the page as a whole holds content
        for i in range(1, n):
            p00, p01, p10, p11 = self.edge[t.features[i][0]]
            x = exp(max(-40.0, min(40.0, full[t.parent[i]] - sent[i])))
            full[i] = up[i] + log((p11 * x + p01) / (p10 * x + p00))
        return full

    def blocks(self, page: str | None) -> list[str]:
        """The content blocks of a page in its order."""
        t = Tree(page)
        odds = self.marginals(t)
        return [x for x, o in zip(t.text, odds, strict=True) if x is not None and o >= 0]


def labelled_pages(n: int = 300, seed: int = 11) -> list[str]:
    """Pages in many layouts; the attribute data-keep says what is content."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvé") for _ in range(r.randint(1, 9)))
    some = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=3, b=25: some(a, b).capitalize() + r.choice(".....!?")
    para = lambda: " ".join(sentence() for _ in range(r.choice((1, 1, 2, 3, 5))))
    link = lambda: f'<a href="/{word()}">{some(1, 4)}</a>'
    links = lambda k: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(k)) + "</ul>"
    pick = lambda *x: r.choice(x)
    off = lambda tag, names, body: f'<{tag}{f" class={chr(34)}{r.choice(names)}{chr(34)}" if names else ""} data-keep="0">{body}</{tag}>'

    def nav() -> str:
        return pick(off("nav", None, links(r.randint(2, 9))), off("nav", ["menu", "main-nav"], links(r.randint(2, 9))), off("div", ["menu", "navbar", "breadcrumbs"], links(r.randint(2, 6))), off("div", ["top", "row"], " | ".join(link() for _ in range(r.randint(2, 6)))), off("header", None, f"<h1>{some(1, 4)}</h1>{links(4)}"), off("header", ["site-header"], f"<p>{sentence()}</p>"))

    def advert() -> str:
        return off("div", ["ad", "ads", "advert", "banner-top", "sponsored", "promo"], pick(sentence(), f"<p>{para()}</p>", link() + " " + sentence()))

    def side() -> str:
        return pick(off("aside", None, f"<h3>{some(1, 3)}</h3>{links(4)}"), off("aside", ["sidebar"], f"<p>{para()}</p>"), off("div", ["sidebar", "related", "share", "widget"], pick(links(4), f"<p>{sentence()}</p>")))

    def notice() -> str:
        return pick(off("div", ["cookie-notice", "consent", "alert"], f"<p>{para()}</p>"), off("form", None, f"<label>{some(1, 4)}</label> {sentence()}"), off("div", ["newsletter", "login-modal"], f"<p>{sentence()}</p>"))

    def comments() -> str:
        return off(pick("section", "div"), ["comments", "comment-list", "discussion"], f"<h3>{some(1, 2)}</h3>" + "".join(f"<{t}><p>{para()}</p></{t}>" for t in [pick("div", "div", "div", "div", "li", "article")] for _ in range(r.randint(1, 5))))

    def foot() -> str:
        return pick(off("footer", None, f"&copy; {word()}.example &middot; {sentence()}"), off("footer", None, links(4) + f"<p>{para()}</p>"), off("div", ["footer", "copyright"], sentence()))

    def inside() -> str:
        title = "".join(f"<{h}>{some(2, 9)}{pick('', '.', '?')}</{h}>" for h in [pick("h1", "h1", "h2")])
        parts = [f"<header>{title}</header>" if r.random() < 0.25 else title]
        for _ in range(r.randint(1, 14)):
            parts.append(pick(f"<p>{para()}</p>", f"<p>{para()}</p>", f"<p>{para()}</p>", f"<p>{sentence(1, 4)}", f"<p><b>{para()}<br><p>{para()}</p>", f"<p>{para()} {link()} {sentence()}</p>", f"<h2>{some(1, 6)}</h2>", f"<ul>{''.join(f'<li>{sentence()}</li>' for _ in range(3))}</ul>", f"<blockquote>{para()}</blockquote>", f"<pre>{some(3, 20)}</pre>", f"<table><tr><td>{some(1, 5)}</td><td>{some(1, 3)}</td></tr></table>", f"<figure><figcaption>{sentence()}</figcaption></figure>", f"<div>{para()}</div>", pick(advert, side, notice)() if r.random() < 0.4 else f"<p>{para()}</p>"))
        return "".join(parts)

    out = []
    for _ in range(n):
        kind = r.random()
        body = inside()
        if kind < 0.5:
            core = f'<article data-keep="1">{body}</article>'
        elif kind < 0.65:
            core = f'<main data-keep="1">{body}</main>'
        elif kind < 0.85:
            core = f'<div {pick("class", "id")}="{pick("content", "post-body", "entry", "article-text", "story")}" data-keep="1">{body}</div>'
        else:  # nothing but the text itself tells
            core = f'<div{pick("", " class=col", " class=wide")} data-keep="1">{body}</div>'
        if r.random() < 0.3:
            core = f'<{pick("main", "section", "div")}>{core}{side() if r.random() < 0.4 else ""}</{"div"}>'
        before = "".join(f() for f in r.sample([nav, advert, side, notice], r.randint(1, 3)))
        after = "".join(f() for f in r.sample([comments, advert, side, notice], r.randint(0, 3))) + (foot() if r.random() < 0.9 else "")
        out.append(f"<html><head><title>{some(2, 6)}</title><script>{some(2, 6)}</script></head><body>{before}{core}{after}</body></html>" if r.random() < 0.85 else f"{before}{core}" if r.random() < 0.5 else core)
    return out


@cache
def default_model() -> Model:
    return Model([Tree(p) for p in labelled_pages()])


def extract(pages: DataFrame, *, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """pages with text (content blocks joined by a space), n_chars (its code points) and n_blocks."""
    shared = pages.sparkSession.sparkContext.broadcast(default_model())

    def rows(b: pa.RecordBatch) -> dict:
        found = [shared.value.blocks(p) for p in b.column(b.schema.get_field_index(html)).to_pylist()]
        texts = [" ".join(x) for x in found]
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64()), "n_blocks": pa.array([len(x) for x in found], pa.int32())}

    keep = list(pages.columns) if keep is None else keep
    return append_map(pages.withColumn(html, F.col(f"`{html}`").cast("string")), keep, rows, "text string, n_chars bigint, n_blocks int")
