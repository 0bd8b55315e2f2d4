"""A small reader of HTML as it comes: elements with what stands in them, missing end tags and all."""

from __future__ import annotations

import re
from html import unescape

_TOKEN = re.compile(r"""<!--(?:.*?(?:-->|--!>)|.*)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)>""", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Elements by how HTML reads them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that end a paragraph that is open.
BLOCKS = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: Elements that stand in a line of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: An element that is opened ends an open one of these, up to a holder of such elements.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tr", "td", "th", "tbody", "thead", "tfoot", "caption"), ("table",)), "thead": (("tbody", "thead", "caption"), ("table",)),
    "tfoot": (("tr", "td", "th", "tbody", "thead"), ("table",)),
    "option": (("option",), ("select", "datalist")), "body": (("head",), ("html",)),
}
#: Beyond these an end tag or an implied end does not reach.
HOLDERS = frozenset("article aside body div footer form header html main nav section table td th blockquote figure fieldset".split())
HEAD_ONLY = frozenset("base basefont bgsound head html link meta noscript script style template title".split())


class Element:
    __slots__ = ("tag", "attributes", "kids")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.kids = tag, attributes, []

    def names(self) -> str:
        """Class, id and role, as they are written."""
        a = self.attributes
        return " ".join(a[k] for k in ("class", "id", "role") if k in a) if a else ""


def _attributes(text: str) -> dict[str, str]:
    out = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(double or single or bare))
    return out


def parse(html: str) -> Element:
    """The page's tree below one element without a name. Text stands among an element's kids, decoded."""
    top = Element("", {})
    open_ = [top]
    at, seek, end = 0, 0, len(html)
    while at < end:
        less = html.find("<", seek)
        m = _TOKEN.match(html, less) if less >= 0 else None
        if less >= 0 and not m:  # a sign in the text
            seek = less + 1
            continue
        text = html[at:less if m else end]
        if text:
            if open_[-1].tag == "head" and text.strip():
                open_.pop()
            open_[-1].kids.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = seek = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            _close(open_, tag)
            continue
        _imply(open_, tag)
        element = Element(tag, _attributes(m[3]) if m[3].strip(" /\t\n\r\f") else {})
        open_[-1].kids.append(element)
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            inside = html[at:stop.start() if stop else end]
            element.kids.append(unescape(inside) if tag in ("title", "textarea") else inside)
            gone = html.find(">", stop.end()) if stop else -1
            at = seek = gone + 1 if gone >= 0 else end
            continue
        open_.append(element)
    return top


def _close(open_: list[Element], tag: str) -> None:
    """Ends the nearest open element of that name with all that is open in it. An inline element's end does not reach
    out of the block it stands in, a paragraph's not out of its holder."""
    inline = tag in INLINE
    for k in range(len(open_) - 1, 0, -1):
        own = open_[k].tag
        if own == tag:
            del open_[k:]
            return
        if (inline and own in BLOCKS) or (tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6") and own in HOLDERS):
            return


def _imply(open_: list[Element], tag: str) -> None:
    if open_[-1].tag == "head" and tag not in HEAD_ONLY:
        open_.pop()
    if tag in BLOCKS:
        for k in range(len(open_) - 1, 0, -1):
            own = open_[k].tag
            if own == "p":
                del open_[k:]
                break
            if own in HOLDERS or own in ("li", "dd", "dt", "button"):
                break
    ends = ENDS.get(tag)
    if ends:
        own, holders = ends
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in holders:
                break
            if open_[k].tag in own:
                del open_[k:]
                if tag in ("li", "dt", "dd", "td", "th", "option"):
                    break
