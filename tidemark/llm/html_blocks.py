"""Text blocks of an HTML page, with what a labeller needs to know of each block's place."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: A quote opens a value only after "="; a value whose quote is never closed is read as unquoted.  Nothing is scanned twice: of each
#: quote at most one is open, and a tag, comment or declaration that does not end ends the page.
_ATTRIBUTE = r"[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>)))?+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/=]++|{_ATTRIBUTE})*+)(?:>|(\Z))|[^<]++|<", re.S)
_NAMES = re.compile(r"(?<![^\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*))", re.I)
_WORD = re.compile(r"[a-z]+")

#: Elements whose content is not text of the page, and those that hold raw characters up to their end tag.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "nobr", "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
#: An opening tag of the second kind ends an open element of the first.
IMPLIED = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}

BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "noscript", "template", "svg", "head", "fieldset", "object", "canvas", "audio", "video", "datalist"}
BOILER_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "advertorial", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "commentlist", "complementary", "consent", "contentinfo", "cookie", "cookies", "dialog", "discussion", "disqus", "footer", "gdpr", "login",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "outbrain", "overlay", "pager", "pagination", "paywall", "popup",
    "promo", "recommended", "related", "replies", "reply", "respond", "responses", "search", "share", "sharing", "sidebar", "signup", "skip",
    "social", "sponsor", "sponsored", "subscribe", "taboola", "teaser", "toolbar", "topbar", "widget", "alert",
}
CONTENT_TAGS = {"article", "main"}
CONTENT_WORDS = {"article", "articlebody", "content", "entry", "main", "post", "story"}


@dataclass
class Element:
    tag: str
    parent: Element | None
    depth: int
    boiler: bool  # it or an ancestor is marked as boilerplate
    content: bool  # it or an ancestor is a content container


@dataclass
class Block:
    text: str
    element: Element
    linked: int  # characters inside links
    kind: str


def _element(tag: str, attributes: str, parent: Element | None) -> Element:
    words: set[str] = set()
    if "=" in attributes:
        for _, a, b, c in _NAMES.findall(attributes):
            words.update(_WORD.findall((a or b or c).lower()))
    wanted = tag in CONTENT_TAGS or bool(words & CONTENT_WORDS)
    marked = words & BOILER_WORDS
    if tag == "article":
        boiler = bool(marked & {"comment", "comments", "reply", "teaser", "related", "promo", "ad", "sponsored"})
    elif tag in ("main", "body", "html"):
        boiler = False
    elif (tag == "header" or "header" in words) and not words & CONTENT_WORDS:
        boiler = not (parent and parent.content) or bool(marked)
    else:
        boiler = tag in BOILER_TAGS or bool(marked) and (not wanted or not words & CONTENT_WORDS)
    above_boiler, above_content = (parent.boiler, parent.content) if parent else (False, False)
    return Element(tag, parent, parent.depth + 1 if parent else 0, above_boiler or boiler, above_content or (wanted and not boiler))


def blocks(page: str) -> list[Block]:
    """The blocks of text in page order; white space in each is one space."""
    found: list[Block] = []
    here = Element("", None, 0, False, False)
    parts: list[str] = []
    inline: Counter[str] = Counter()  # open inline elements of the block
    opened: Counter[str] = Counter()  # open block elements
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                found.append(Block(text, here, min(linked, len(text)), here.tag))
            parts.clear()
        linked = 0

    def close(up: Element) -> None:
        """End all elements below ``up``."""
        nonlocal here
        while here is not up:
            opened[here.tag] -= 1
            here = here.parent

    at, size = 0, len(page)
    while at < size:
        match = _TOKEN.match(page, at)
        token, at = match[0], match.end()
        tag = match[2]
        if tag is None:
            if not token.startswith(("<!", "<?", "</")):
                parts.append(token)
                if inline["a"] > 0:
                    linked += len(token)
            continue
        if match[4] is not None:  # never closed
            break
        tag = tag.lower()
        if match[1]:  # an end tag
            if tag in INLINE:
                inline[tag] -= inline[tag] > 0
            elif tag not in VOID:
                flush()
                inline.clear()
                if opened[tag] > 0:
                    up = here
                    while up.tag != tag:
                        up = up.parent
                    close(up.parent)
            elif tag == "br":
                parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
        elif tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            if tag not in ("script", "style"):
                flush()
        elif tag in INLINE:
            if not match[3].rstrip().endswith("/"):
                inline[tag] += 1
        elif tag in VOID:
            if tag == "hr":
                flush()
        else:
            flush()
            inline.clear()
            if here.tag == "p":
                close(here.parent)
            elif tag in IMPLIED and IMPLIED[tag]:
                up = here
                while up.parent and up.tag in IMPLIED[tag]:
                    up = up.parent
                close(up)
            elif tag == "body" and here.boiler:
                up = here
                while up.parent and up.tag != "html":
                    up = up.parent
                close(up)
            here = _element(tag, match[3], here)
            opened[tag] += 1
            if match[3].rstrip().endswith("/") and tag in ("svg", "template"):
                close(here.parent)
    flush()
    return found
