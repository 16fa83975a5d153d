"""HTML pages as sequences of leaf blocks, and made-up labelled pages to train on."""

from __future__ import annotations

import html
import random
import re
import zlib
from functools import lru_cache

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[a-z]+")
NUMBER = re.compile(r"&#([0-9]{8,});?")
#: Elements whose content is no text of the page: code, what stands in the head, and controls of forms.
RAW = frozenset(["script", "style", "template", "head", "title", "textarea", "select"])
#: Elements that do not interrupt a line of text, parts of formulas and drawings among them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics annotation "
    "svg g path use text tspan defs desc circle ellipse rect line polyline polygon object param canvas iframe".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that opens closes open ones of these names, up to the nearest container.
CLOSES = {
    "p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"),
    "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",),
} | {t: ("p",) for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
CONTAINERS = frozenset("article aside blockquote body div dl fieldset figure footer form header main nav ol section table tbody thead ul".split())
ITEMS = frozenset(["li", "dt", "dd", "tr", "td", "th"])
CLOSED_FROM_AFAR = ITEMS | {"p"}
#: Buckets of the names above a block.
PATH = 256


class Element:
    """An open element: its names, and what of the elements above it a block needs, so that a block takes no walk."""

    __slots__ = ("above", "tag", "names", "own", "all", "items")

    def __init__(self, above: Element | None, tag: str, attributes: str, depth: int) -> None:
        self.above, self.tag = above, tag
        self.names, self.own, mine = _names(tag, attributes) if len(attributes) < 300 else _names.__wrapped__(tag, attributes)
        self.all = mine | (above.all if above else 0)
        items = {} if tag in CONTAINERS or above is None else above.items
        self.items = items | {tag: depth} if tag in CLOSED_FROM_AFAR else items


@lru_cache(maxsize=20_000)
def _names(tag: str, attributes: str) -> tuple[tuple[str, ...], int, int]:
    """The names of an element, and the sets of their buckets as a near element and as one anywhere above."""
    out = [tag]
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            out += ["." + x for x in NAME.findall((m[2] or m[3] or m[4] or "").lower())]
    near = far = 0
    for x in set(out):
        near |= 1 << zlib.crc32(("near " + x).encode()) % PATH
        far |= 1 << zlib.crc32(x.encode()) % PATH
    return tuple(out), near, far


class Block:
    """One leaf: its text, the element it stands in, and the share of linked characters."""

    __slots__ = ("text", "element", "links")

    def __init__(self, text: str, element: Element | None, links: float) -> None:
        self.text, self.element, self.links = text, element, links

    @property
    def path(self) -> tuple[str, ...]:
        """The names of all elements above, outermost first."""
        out, e = [], self.element
        while e:
            out.append(e.names)
            e = e.above
        return tuple(x for names in reversed(out) for x in names)

    def masks(self) -> bytes:
        """Buckets of the names anywhere above, then of those of the two nearest elements."""
        e = self.element
        if e is None:
            return bytes(PATH // 4)
        near = e.own | (e.above.own if e.above else 0)
        return e.all.to_bytes(PATH // 8, "little") + near.to_bytes(PATH // 8, "little")


def _decoded(text: str) -> str:
    # A number beyond all characters; int() refuses very long ones.
    text = NUMBER.sub(lambda m: f"&#{m[1].lstrip('0')[:8] or 0};", text)
    return " ".join(html.unescape(text).split())


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of a page in order; text is decoded, white space is one space.

    One scan forward.  What a failed look ahead has shown (no closing tag, no
    closing quote up to the end) is remembered, so the time is proportional to
    the length for any page.
    """
    if not page:
        return []
    out: list[Block] = []
    stack: list[Element] = []
    count: dict[str, int] = {}
    text: list[str] = []
    total = linked = in_link = 0

    def flush() -> None:
        nonlocal total, linked
        if text:
            line = _decoded("".join(text))
            if line:
                out.append(Block(line, stack[-1] if stack else None, linked / max(total, 1)))
            text.clear()
        total = linked = 0

    def close_to(k: int) -> None:
        for e in stack[k:]:
            count[e.tag] -= 1
        del stack[k:]

    at, look, end, last = 0, 0, len(page), page.rfind(">")
    tag_at, unclosed = TAG, set()
    while at < end:
        lt = page.find("<", look)
        if lt < 0 or lt > last:
            lt = end
        stop, m, skip = lt, None, 0
        if lt < end:
            after = page[lt + 1 : lt + 4]
            if after == "!--":
                k = page.find("-->", lt + 4)
                skip = k + 3 if k >= 0 else end
            elif after[:1] in ("!", "?"):
                skip = page.find(">", lt) + 1
            elif after[:1].isalpha() or after[:1] == "/":
                m = tag_at.match(page, lt)
                if m is None and tag_at is TAG and (m := PLAIN.match(page, lt)):
                    tag_at = PLAIN  # a quote is open to the end; from here on tags end at the first >
            if not skip and m is None:
                look = lt + 1
                continue
        if stop > at:
            text.append(page[at:stop])
            total += stop - at
            linked += (stop - at) * (in_link > 0)
        if lt == end:
            break
        at = look = skip or m.end()
        if skip:
            continue
        closing, tag, attributes = m[1] == "/", m[2].lower(), m[3]
        if tag in RAW and not closing:
            if tag != "title":
                text.append(" ")
            if attributes.endswith("/"):
                continue
            close = None if tag in unclosed else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if close:
                at = look = close.end()
            else:
                unclosed.add(tag)
                at = look = end if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = max(0, in_link - 1) if closing else 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        flush()
        in_link = 0 if tag not in ("hr",) else in_link
        if closing:
            if count.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close_to(k)
            continue
        if tag in VOID:
            continue
        close = CLOSES.get(tag, ())
        while close and stack and stack[-1].tag in close:
            close_to(len(stack) - 1)
        if tag in ITEMS and stack:
            k = max(stack[-1].items.get(t, -1) for t in close)
            if k >= 0:
                close_to(k)
        if not attributes.endswith("/"):
            stack.append(Element(stack[-1] if stack else None, tag, attributes, len(stack)))
            count[tag] = count.get(tag, 0) + 1
    flush()
    return out


# Made-up pages.  Every region is a list of (html, is main text) pieces; words
# are invented, so that structure and position decide, not the vocabulary.

MAIN = ["content", "main-content", "post", "entry-content", "article-body", "story", "post-content", "text", "page-content", "article", "body-text", "entry"]
JUNK = {
    "nav": ["nav", "menu", "navbar", "main-nav", "navigation", "top-menu", "breadcrumb", "breadcrumbs", "pagination", "site-nav", "links", "toc"],
    "header": ["header", "site-header", "top", "masthead", "banner", "branding", "logo", "topbar"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "legal", "colophon", "credits"],
    "side": ["sidebar", "side", "widget", "related", "recommended", "popular", "aside", "more", "trending", "tags"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "adsense", "sponsor"],
    "notice": ["cookie", "cookie-banner", "notice", "gdpr", "consent", "alert", "popup", "newsletter", "subscribe", "paywall", "disclaimer", "modal"],
    "form": ["form", "search", "login", "signup", "contact-form", "search-form", "subscribe-form"],
    "comment": ["comments", "comment", "comment-list", "responses", "discussion", "replies", "reader-comments", "disqus", "commentlist", "reply"],
    "share": ["share", "social", "sharing", "share-buttons", "byline-tools", "follow"],
}
NEUTRAL = ["row", "col", "wrapper", "container", "inner", "box", "clearfix", "grid", "block", "section", "layout", "module", "wrap", "left", "right", "page"]


class PageMaker:
    """Pages of many layouts with the label of every block."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        letters = "abcdefghijklmnopqrstuvwxyzéäöñ"
        self.words = ["".join(self.r.choices(letters, k=self.r.randint(1, 9))) for _ in range(3000)]

    def prose(self, lo: int, hi: int) -> str:
        n = self.r.randint(lo, hi)
        mark = self.r.choice(["", "", "", "&amp;", "#", "%"])
        out = [w + (mark if self.r.random() < 0.3 else "") for w in self.r.choices(self.words, k=n)]
        for i in range(0, n, self.r.randint(5, 15)):
            out[i] = out[i].capitalize()
            if i:
                out[i - 1] += "."
        text = " ".join(out) + self.r.choice([".", ".", "", "!"])
        return f"<b>{text}<br>" if self.r.random() < 0.1 else f"<em>{text}</em>" if self.r.random() < 0.05 else text

    def names(self, kind: list[str]) -> str:
        r = self.r.random()
        some = [self.r.choice(kind)] + ([self.r.choice(NEUTRAL)] if self.r.random() < 0.3 else [])
        self.r.shuffle(some)
        return f' class="{" ".join(some)}"' if r < 0.7 else f' id="{some[0]}"' if r < 0.85 else f' class="{" ".join(some)}" id="{self.r.choice(kind)}"'

    def wrap(self, tag: str, names: str, inside: list) -> list:
        return [(f"<{tag}{names}>", None), *inside, (f"</{tag}>", None)]

    def leaf(self, tag: str, text: str, label: bool) -> list:
        close = "" if tag in ("p", "li") and self.r.random() < 0.15 else f"</{tag}>"
        return [(f"<{tag}>", None), (text, label), (close, None)]

    def items(self, label: bool, links: bool, n: int) -> list:
        out = []
        for _ in range(n):
            text = self.prose(1, 4 if links else 15)
            out += self.leaf("li", f'<a href="/{self.r.randint(0, 99)}">{text}</a>' if links else text, label)
        return self.wrap(self.r.choice(["ul", "ol"]), "", out)

    def junk(self, kind: str) -> list:
        tags = {"nav": ["nav", "div", "nav", "ul"], "header": ["header", "div"], "footer": ["footer", "div", "footer"], "side": ["aside", "div", "section"], "form": ["form", "div"], "comment": ["section", "div", "ol"]}
        tag = self.r.choice(tags.get(kind, ["div", "div", "section", "aside", "p"] if kind != "ad" else ["div", "div", "ins", "aside"]))
        bare = tag in ("nav", "header", "footer", "aside", "form") and self.r.random() < 0.5
        names = "" if bare else self.names(JUNK[kind])
        if tag == "ins":
            tag = "div"
        if tag == "p":
            return self.wrap("p", names, [(self.prose(3, 40), False)])
        if kind == "nav" or kind == "side" and self.r.random() < 0.5:
            inside = self.items(False, True, self.r.randint(2, 9))
            if tag == "ul":
                inside = inside[1:-1]
        elif kind == "comment":
            inside = self.leaf(self.r.choice(["h2", "h3"]), self.prose(1, 3), False)
            for _ in range(self.r.randint(1, 5)):
                one = self.leaf("p", self.prose(4, 60), False)
                if self.r.random() < 0.5:
                    one = self.leaf("span", self.prose(1, 2), False) + one
                inside += self.wrap(self.r.choice(["div", "li", "article"]), self.names(JUNK["comment"]) if self.r.random() < 0.6 else "", one)
        elif kind == "form":
            inside = [('<label>', None), (self.prose(1, 3), False), ('</label><input type="text"><button>', None), (self.prose(1, 2), False), ("</button>", None)]
        elif kind == "footer":
            inside = [(f"&copy; {self.prose(1, 4)} &middot; {self.prose(3, 20)}", False)] + (self.items(False, True, 3) if self.r.random() < 0.3 else [])
        else:
            n = self.r.randint(1, 3)
            inside = [(self.prose(2, 40), False)] if n == 1 else [x for _ in range(n) for x in self.leaf("p", self.prose(2, 40), False)]
        return self.wrap(tag, names, inside)

    def main(self) -> list:
        out = self.leaf(self.r.choice(["h1", "h1", "h2"]), self.prose(3, 12), True) if self.r.random() < 0.85 else []
        for _ in range(self.r.randint(1, 14)):
            x = self.r.random()
            if x < 0.75:
                out += self.leaf("p", self.prose(1, 160), True)
            elif x < 0.8:
                out += self.leaf(self.r.choice(["h2", "h3"]), self.prose(1, 8), True)
            elif x < 0.85:
                out += self.items(True, self.r.random() < 0.15, self.r.randint(2, 6))
            elif x < 0.88:
                out += self.wrap("blockquote", "", self.leaf("p", self.prose(5, 40), True))
            elif x < 0.9:
                out += self.leaf(self.r.choice(["pre", "figcaption", "div"]), self.prose(3, 30), True)
            elif x < 0.92:
                out += [("<table><tr>", None), *self.leaf("td", self.prose(1, 8), True), *self.leaf("td", self.prose(1, 8), True), ("</tr></table>", None)]
            else:
                out += self.junk(self.r.choice(["ad", "ad", "share", "notice", "side", "form"]))
        if self.r.random() < 0.15:
            out += self.junk(self.r.choice(["comment", "share", "side"]))
        tag = self.r.choice(["article", "article", "main", "div", "section", "td", "div"])
        names = "" if tag in ("article", "main") and self.r.random() < 0.6 else self.names(MAIN)
        out = self.wrap(tag, names, out) if tag != "td" else [("<table><tr>", None), *self.wrap(tag, names, out), ("</tr></table>", None)]
        for _ in range(self.r.choice([0, 0, 0, 1, 1, 2])):
            out = self.wrap(self.r.choice(["div", "main", "section"]), self.names(NEUTRAL) if self.r.random() < 0.7 else "", out)
        return out

    def page(self) -> list:
        """Pieces (html, label); label is None for markup."""
        r = self.r
        head = [("<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body><script>var t='</p>'</script>", None)]
        before = [k for k in ("header", "nav", "notice", "ad", "form", "side", "nav") if r.random() < 0.4]
        if r.random() < 0.3:
            r.shuffle(before)
        after = [k for k in ("share", "comment", "side", "ad", "notice", "form", "footer") if r.random() < 0.4]
        if r.random() < 0.3 and "footer" not in after:
            after.append("footer")
        out = list(head)
        for k in before:
            out += self.junk(k)
            if r.random() < 0.1:
                out.append(("<!-- x -->", None))
        out += self.main()
        for k in after:
            out += self.junk(k)
        return [*out, ("</body></html>", None)]

    def labelled(self) -> tuple[list[Block], list[bool]]:
        """Blocks of a page and whether each is main text."""
        mark = {True: "", False: ""}
        page = "".join(x if label is None else mark[label] + x for x, label in self.page())
        found = [b for b in blocks_of(page) if b.text.strip(" ")]
        labels = [b.text.count(mark[True]) > b.text.count(mark[False]) for b in found]
        for b in found:
            b.text = b.text.replace(mark[True], "").replace(mark[False], "").strip()
        return found, labels
