"""A light element tree over the standard library's tokenizer, for the parts of HTML that columns can't express."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

_VOID = frozenset("area base basefont br col command embed frame hr img input keygen link menuitem meta param source spacer track wbr".split())


class Element:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Element]:
        """Elements below, in document order."""
        stack = self.children[::-1]
        while stack:
            child = stack.pop()
            if isinstance(child, Element):
                yield child
                stack += child.children[::-1]

    def all(self, *tags: str, where: Callable[[Element], bool] = lambda e: True) -> list[Element]:
        return [e for e in self.walk() if (not tags or e.tag in tags) and where(e)]

    def first(self, *tags: str, where: Callable[[Element], bool] = lambda e: True) -> Element | None:
        return next((e for e in self.walk() if (not tags or e.tag in tags) and where(e)), None)

    def strings(self) -> Iterator[str]:
        stack = self.children[::-1]
        while stack:
            child = stack.pop()
            if isinstance(child, Element):
                stack += child.children[::-1]
            else:
                yield child

    def text(self, strip: bool = True) -> str:
        """All text; strip: each string trimmed."""
        return "".join(s.strip() for s in self.strings()) if strip else "".join(self.strings())

    def after(self) -> list[Element]:
        """Sibling elements after this one."""
        if self.parent is None:
            return []
        own = self.parent.children
        at = next(i for i, c in enumerate(own) if c is self)
        return [c for c in own[at + 1 :] if isinstance(c, Element)]

    def above(self, tag: str) -> Element | None:
        e = self.parent
        while e is not None and e.tag != tag:
            e = e.parent
        return e


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Element("[document]", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        new = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.now)
        self.now.children.append(new)
        if tag not in _VOID:
            self.now = new

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.now = self.now.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        e = self.now
        while e is not self.root and e.tag != tag:
            e = e.parent
        if e is not self.root:
            self.now = e.parent

    def handle_data(self, data: str) -> None:
        own = self.now.children
        if own and isinstance(own[-1], str):
            own[-1] += data
        else:
            own.append(data)


_BLANK = r"[ \t\n\r\f]"
_NAME = r"[a-zA-Z][a-zA-Z0-9]*"
_ATTRIBUTE = rf'{_BLANK}+([a-zA-Z][-_a-zA-Z0-9]*)(="[^"<>&\x00]*")?'
#: Markup that needs no care: text, end tags, start tags of attributes without quotes or in double ones, document types, comments.
_TOKEN = re.compile(
    rf'([^<\x00]+)|</({_NAME})>|<({_NAME})((?:{_ATTRIBUTE.replace("(", "(?:")})*){_BLANK}*(/?)>|<!(?i:doctype) [^<>"\'\[\]\x00]*>|<!--[^<>\-\x00]+-->'
)
_ATTRIBUTE = re.compile(_ATTRIBUTE)
#: Elements of plain text, and those that the tokenizer treats as special in some version.
_RAW, _SPECIAL = frozenset(("script", "style")), frozenset("textarea title iframe noembed noframes noscript xmp plaintext svg math".split())


@lru_cache(4096)
def _attributes(raw: str) -> tuple[tuple[str, str], ...]:
    return tuple((name.lower(), value[2:-1]) for name, value in reversed(_ATTRIBUTE.findall(raw)))


def _quick(html: str) -> Element | None:
    """The tree as _Builder makes it, in a fraction of the time; None if html has anything but plain markup."""
    root = now = Element("[document]", {}, None)
    at, raw = 0, None
    for m in _TOKEN.finditer(html):
        if m.start() != at:
            return None
        at, kind = m.end(), m.lastindex
        if kind == 1:
            text = m[1]
            if "&" in text:
                if raw or at == len(html):
                    return None
                text = unescape(text)
            own = now.children
            if own and isinstance(own[-1], str):
                own[-1] += text
            else:
                own.append(text)
            continue
        if raw and (kind != 2 or m[2].lower() != raw):
            return None
        if kind == 2:
            tag, e = m[2].lower(), now
            raw = None
            while e is not root and e.tag != tag:
                e = e.parent
            if e is not root:
                now = e.parent
        elif kind is not None:
            tag = m[3].lower()
            if tag in _SPECIAL or (tag in _RAW and m[5]):
                return None
            new = Element(tag, dict(_attributes(m[4])) if m[4] else {}, now)
            now.children.append(new)
            if tag not in _VOID and not m[5]:
                now = new
                raw = tag if tag in _RAW else None
    return root if at == len(html) and not raw else None


def parse(html: str | None) -> Element:
    return _quick(html or "") or parse_any(html)


def parse_any(html: str | None) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
