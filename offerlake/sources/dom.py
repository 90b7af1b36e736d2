"""HTML read in one pass: all selectors of a site are matched while its tags stream by. Standard library only.

No tree is built. A stack of open elements carries, as bits of one integer, how far each chain of simple selectors is matched by an element or those
around it, so a start tag costs the same at any depth. What is kept is the text of captured elements. End tags that HTML lets one leave out
are implied: a table's row or cell, a list's entry, a paragraph or an option ends where the next begins or what holds it ends.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_PART = re.compile(r"([A-Za-z][\w-]*|\*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([*^$]?=)[\"']?([^\"'\]]*)[\"']?)?\]|:(last-child)")

# Start tags that imply an end (of which open elements, unless one of the others lies between).
_BLOCKS = "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
_CELL, _ROW, _PART_OF_TABLE = ("td", "th"), ("tr",), ("thead", "tbody", "tfoot")
_P = (("p",), ("table", "td", "th", "caption", "button", "object", "li", "dd", "dt"))
IMPLIED = {
    "li": ((("li",), ("ul", "ol", "menu")),), "dt": ((("dt", "dd"), ("dl",)),), "dd": ((("dt", "dd"), ("dl",)),), "option": ((("option",), ("select",)),), "optgroup": ((("option", "optgroup"), ("select",)),),
    "td": ((_CELL, ("table", "tr")),), "th": ((_CELL, ("table", "tr")),), "tr": ((_ROW, ("table",)),), **{t: ((_PART_OF_TABLE, ("table",)), (_ROW, ("table",))) for t in _PART_OF_TABLE}, **{t: (_P,) for t in _BLOCKS},
}


@dataclass(frozen=True)
class Simple:
    """A simple selector: what one element must have."""

    tag: str | None
    classes: frozenset
    id: str | None
    attrs: tuple
    last: bool

    @staticmethod
    def of(text: str) -> Simple:
        tag, classes, id_, attrs, last = None, set(), None, [], False
        for m in _PART.finditer(text):
            t, c, i, name, op, value, end = m.groups()
            tag = t if t and t != "*" else tag
            classes |= {c} if c else set()
            id_ = i or id_
            attrs += [(name, op, value)] if name else []
            last = last or bool(end)
        return Simple(tag, frozenset(classes), id_, tuple(attrs), last)

    def fits(self, tag: str, attrs: dict[str, str], classes: set) -> bool:
        if self.tag and self.tag != tag or not self.classes <= classes or self.id and attrs.get("id") != self.id:
            return False
        for name, op, value in self.attrs:
            have = attrs.get(name)
            if have is None or op == "=" and have != value or op == "*=" and value not in have or op == "^=" and not have.startswith(value) or op == "$=" and not have.endswith(value):
                return False
        return True


class Selectors:
    """Chains of simple selectors, each with what it stands for, as bits. ``:last-child`` may be in a chain's last part only."""

    def __init__(self, wanted: list[tuple[str, object]]) -> None:
        self.by: dict[str, list[tuple[int, Simple]]] = {}
        self.starts, self.ends, self.last, self.means, n = 0, 0, 0, {}, 0
        for selector, meaning in wanted:
            for chain in selector.split(","):
                parts = [Simple.of(p) for p in chain.split()]
                if not parts or any(p.last for p in parts[:-1]):
                    raise ValueError(f"not a selector that is known here: {chain!r}")
                self.starts |= 1 << n
                for p in parts:
                    key = f"#{p.id}" if p.id else f".{min(p.classes)}" if p.classes else p.tag or "*"
                    self.by.setdefault(key, []).append((1 << n, p))
                    n += 1
                end = 1 << (n - 1)
                self.ends |= end
                self.last |= end if parts[-1].last else 0
                self.means[end] = meaning

    def fits(self, tag: str, attrs: dict[str, str]) -> int:
        classes = set(attrs["class"].split()) if "class" in attrs else set()
        out = 0
        for key in (tag, "*", *("." + c for c in classes), "#" + attrs["id"] if "id" in attrs else None):
            for bit, simple in self.by.get(key, ()):
                if simple.fits(tag, attrs, classes):
                    out |= bit
        return out


class Capture:
    """An element whose text is wanted. ``first_link`` and ``first_value``: how many of those had begun before it, where that is of use."""

    __slots__ = ("attrs", "start", "text", "sure", "first_link", "last_link", "first_value", "value")

    def __init__(self, attrs: dict[str, str], start: int) -> None:
        self.attrs, self.start, self.text, self.sure, self.first_link, self.last_link, self.first_value, self.value = attrs, start, None, True, -1, 0, -1, None


class _Open:
    __slots__ = ("tag", "reach", "captures", "pending")

    def __init__(self, tag: str, reach: int) -> None:
        self.tag, self.reach, self.captures, self.pending = tag, reach, None, None


class Reader(HTMLParser):
    """``firsts``: for each name its selectors, of which the first that fits anything counts, and of what fits the first element. ``links``: the
    name whose links are wanted. ``rows``: what all fits are wanted of, each with the first fit of ``values`` in it."""

    def __init__(self, selectors: Selectors, links: str | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.selectors, self.links_of = selectors, links
        self.stack, self.at = [_Open("", 0)], {}
        self.chunks: list[str] = []
        self.open = self.hidden = self.links_open = 0
        self.firsts: dict[str, dict[int, Capture]] = {}
        self.links: list[Capture] = []
        self.rows: list[Capture] = []
        self.values: list[Capture] = []

    def first(self, name: str) -> Capture | None:
        found = self.firsts.get(name)
        return found[min(found)] if found else None

    def links_in(self, capture: Capture) -> list[Capture]:
        return self.links[capture.first_link : capture.last_link]

    def _capture(self, el: _Open, attrs: dict[str, str]) -> Capture:
        out = Capture(attrs, len(self.chunks))
        el.captures = [*(el.captures or ()), out]
        self.open += 1
        return out

    def _matched(self, el: _Open, here: int, attrs: dict[str, str], parent: _Open) -> None:
        # each meaning once, whatever the chains that lead to it; one that is sure at once goes before one that must be a last child
        ends, means = here & self.selectors.ends, {}
        while ends:
            bit = ends & -ends
            ends ^= bit
            meaning, late = self.selectors.means[bit], bool(bit & self.selectors.last)
            means[meaning] = means.get(meaning, True) and late
        for meaning, late in sorted(means.items(), key=lambda x: x[0][0] == "row"):  # an element is no value of itself
            kind, *which = meaning
            if kind == "first":
                name, place = which
                have = self.firsts.setdefault(name, {})
                if not have or min(have) > place:
                    have[place] = c = self._capture(el, attrs)
                    if name == self.links_of:
                        c.first_link = len(self.links)
                        self.links_open += 1
            elif kind == "row":
                c = self._capture(el, attrs)
                c.first_value = len(self.values)
                self.rows.append(c)
            else:
                c = self._capture(el, attrs)
                c.sure = not late
                self.values.append(c)
                if late:
                    parent.pending = c

    def _end(self, el: _Open) -> None:
        if el.pending is not None:
            el.pending.sure = True
        for c in el.captures or ():
            c.text = "".join(self.chunks[c.start :])
            self.open -= 1
            if c.first_link >= 0:
                c.last_link = len(self.links)
                self.links_open -= 1
            if c.first_value >= 0:
                c.value = next((v for v in self.values[c.first_value :] if v.sure), None)
        if not self.open:
            self.chunks.clear()

    def _pop_to(self, index: int) -> None:
        while len(self.stack) > index:
            el = self.stack.pop()
            self.at[el.tag].pop()
            self.hidden -= el.tag in ("script", "style")
            self._end(el)

    def _begin(self, tag: str, attrs, stays: bool) -> None:
        top = lambda tags: max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)
        for ended, between in IMPLIED.get(tag, ()):
            k = top(ended)
            if k and k > top(between):
                self._pop_to(k)
        parent = self.stack[-1]
        parent.pending = None
        own = {k: v or "" for k, v in attrs}
        fits = self.selectors.fits(tag, own)
        here = fits & (self.selectors.starts | parent.reach << 1)
        el = _Open(tag, parent.reach | here)
        below = self.links_open
        if here & self.selectors.ends:
            self._matched(el, here, own, parent)
        if tag == "a" and "href" in own and below:
            self.links.append(self._capture(el, own))
        if stays:
            self.at.setdefault(tag, []).append(len(self.stack))
            self.stack.append(el)
            self.hidden += tag in ("script", "style")
        else:
            self._end(el)

    def handle_starttag(self, tag, attrs):
        self._begin(tag, attrs, tag not in VOID)

    def handle_startendtag(self, tag, attrs):
        self._begin(tag, attrs, False)

    def handle_endtag(self, tag):
        if self.at.get(tag):
            self._pop_to(self.at[tag][-1])

    def handle_data(self, data):
        if self.open and not self.hidden:
            self.chunks.append(data)

    def read(self, html: str | None) -> Reader:
        self.feed(html or "")
        self.close()
        self._pop_to(1)
        self._end(self.stack[0])
        return self


def read(html: str | None, firsts: dict[str, tuple[str, ...]], *, links: str | None = None, rows: str = "", values: str = "") -> Reader:
    return Reader(selectors(firsts, rows, values), links).read(html)


def selectors(firsts: dict[str, tuple[str, ...]], rows: str = "", values: str = "") -> Selectors:
    """Compiled once for all pages of a site."""
    wanted = [(s, ("first", name, k)) for name, some in firsts.items() for k, s in enumerate(some)]
    wanted += [(rows, ("row",))] if rows else []
    return Selectors(wanted + ([(values, ("value",))] if rows and values else []))
