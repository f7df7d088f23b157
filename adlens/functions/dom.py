"""An element tree of one page: preorder intervals, text by place, and the selectors that the page operators ask for.

Each element has its place in document order and the place behind its last descendant, so that "inside", "earlier sibling"
and "nearest ancestor" are comparisons of numbers. This is the small helper behind `operators.pages.read_html`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style noscript svg iframe template".split())
BLOCK = frozenset("p div br li ul ol tr td th h1 h2 h3 h4 h5 h6 section article header footer nav aside main table title option button".split())
#: Tags that an opening tag closes if they are open, and the tags that shield them.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def collapse(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    parent: int  # its place, -1 at the top
    end: int = -1  # the place behind its last descendant
    children: list[int] = field(default_factory=list)
    first_text: int = 0
    last_text: int = 0


class Tree(HTMLParser):
    def __init__(self, html: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.open: list[int] = []
        self.texts: list[str] = []  # every piece of text, hidden ones as none
        self.hidden = 0
        self.raw: dict[int, str] = {}  # of scripts
        self.feed(html or "")
        self.close()
        while self.open:
            self._shut()

    def _shut(self) -> None:
        at = self.open.pop()
        e = self.elements[at]
        e.end, e.last_text = len(self.elements), len(self.texts)
        self.hidden -= e.tag in HIDDEN
        if e.tag in BLOCK:
            self.texts.append(" ")

    def _shut_within(self, tags: set[str], shields: set[str]) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.elements[self.open[depth]].tag
            if tag in shields:
                return
            if tag in tags:
                while len(self.open) > depth:
                    self._shut()
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CLOSES:
            self._shut_within(*_CLOSES[tag])
        if tag in _ENDS_P:
            self._shut_within({"p"}, {"button", "table", "td", "th"})
        if tag in BLOCK:
            self.texts.append(" ")
        at = len(self.elements)
        parent = self.open[-1] if self.open else -1
        self.elements.append(Element(tag, {k: v or "" for k, v in reversed(attrs)}, parent, at + 1, [], len(self.texts), len(self.texts)))
        if parent >= 0:
            self.elements[parent].children.append(at)
        if tag not in VOID:
            self.open.append(at)
            self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK and tag not in ("a", "script", "title"):  # in HTML the slash says nothing, in SVG it ends
            self._shut()

    def handle_endtag(self, tag: str) -> None:
        if any(self.elements[at].tag == tag for at in self.open):
            while self.elements[self.open[-1]].tag != tag:
                self._shut()
            self._shut()

    def handle_data(self, data: str) -> None:
        if self.open and self.elements[self.open[-1]].tag == "script":
            self.raw[self.open[-1]] = self.raw.get(self.open[-1], "") + data
        self.texts.append("" if self.hidden else data)

    # What the operators ask.

    def text(self, at: int) -> str:
        e = self.elements[at]
        return collapse("".join(self.texts[e.first_text : e.last_text]))

    def ancestors(self, at: int) -> Iterator[int]:
        """From the parent up."""
        while (at := self.elements[at].parent) >= 0:
            yield at

    def closest(self, at: int, tags: frozenset[str]) -> int:
        """The element itself or its nearest ancestor of a tag, or -1."""
        return next((k for k in (at, *self.ancestors(at)) if self.elements[k].tag in tags), -1)

    def inside(self, at: int) -> range:
        return range(at + 1, self.elements[at].end)

    def all(self, *tags: str) -> list[int]:
        return [k for k, e in enumerate(self.elements) if e.tag in tags]

    def body(self) -> str:
        """All visible text but the head's; a page without a body tag is one all the same."""
        found = self.all("body")
        if found:
            return self.text(found[0])
        heads = [self.elements[k] for k in self.all("head", "title")]
        return collapse("".join(x for k, x in enumerate(self.texts) if not any(h.first_text <= k < h.last_text for h in heads)))

    def select(self, selector: str) -> list[int]:
        """The elements that a selector matches: tags, #id, .class, [attribute], [attribute=value], descendants by a space,
        children by >, alternatives by a comma. A selector with anything else matches nothing."""
        found: set[int] = set()
        for path in _paths(selector):
            tag, conditions = path[-1][1]
            here = (k for k, e in enumerate(self.elements) if (not tag or e.tag == tag) and (e.attrs or not conditions))
            found.update(k for k in here if self._matches(k, path))
        return sorted(found)

    def _matches(self, at: int, path: list[tuple[str, tuple]]) -> bool:
        link, simple = path[-1]
        if not _fits(self.elements[at], simple):
            return False
        if len(path) == 1:
            return True
        above = [self.elements[at].parent] if link == ">" else self.ancestors(at)
        return any(k >= 0 and self._matches(k, path[:-1]) for k in above)


_PART = re.compile(r"""([#.])([\w-]+)|\[\s*([\w-]+)\s*(?:([~^$*|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]""")


@lru_cache(256)
def _paths(selector: str) -> list[list[tuple[str, tuple]]]:
    return [p for p in map(_path, selector.split(",")) if p]


def _path(selector: str) -> list[tuple[str, tuple]]:
    """A selector as (how it hangs on the one before, (tag, conditions)) for each of its steps; empty where it cannot be read."""
    out, link = [], " "
    for step in re.findall(r""">|(?:[^\s>\["']|\[[^\]]*\])+""", selector):
        if step == ">":
            link = ">"
            continue
        tag = re.match(r"\*|[A-Za-z][\w-]*", step)
        rest, conditions = step[tag.end() :] if tag else step, []
        while rest:
            if not (m := _PART.match(rest)):
                return []
            if m[1]:
                conditions.append(("id" if m[1] == "#" else "class", "=" if m[1] == "#" else "~=", m[2]))
            else:
                conditions.append((m[3].lower(), m[4] or "", next((x for x in m.group(5, 6, 7) if x is not None), "")))
            rest = rest[m.end() :]
        out.append((link, (tag[0].lower() if tag and tag[0] != "*" else "", conditions)))
        link = " "
    return out


def _fits(e: Element, simple: tuple) -> bool:
    tag, conditions = simple
    if tag and e.tag != tag:
        return False
    for name, how, value in conditions:
        own = e.attrs.get(name)
        if own is None:
            return False
        if how == "~=":
            good = value in own.split()
        elif how == "=":
            good = own == value
        elif how == "|=":
            good = own == value or own.startswith(value + "-")
        elif how:
            good = value != "" and {"^=": own.startswith, "$=": own.endswith, "*=": own.__contains__}[how](value)
        else:
            good = True
        if not good:
            return False
    return True
