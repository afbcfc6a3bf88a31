"""A small element tree over html.parser: select by tag, class or id; text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Element:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None = None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Element]:
        """Elements below, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            at = todo.pop()
            yield at
            todo += [c for c in reversed(at.children) if isinstance(c, Element)]

    def fits(self, selector: str) -> bool:
        """tag, .class, #id, tag.class or tag#id."""
        tag, classes, ids = re.match(r"([\w-]*)((?:\.[\w-]+)*)(#[\w-]+)?", selector).groups()
        own = (self.attrs.get("class") or "").split()
        return (not tag or tag == self.tag) and all(c in own for c in classes.split(".")[1:]) and (not ids or self.attrs.get("id") == ids[1:])

    def select(self, selectors: str) -> Iterator[Element]:
        wanted = [s.strip() for s in selectors.split(",")]
        return (e for e in self.walk() if any(e.fits(s) for s in wanted))

    def first(self, selectors: str) -> Element | None:
        return next(self.select(selectors), None)

    def strings(self) -> Iterator[str]:
        todo = list(reversed(self.children))
        while todo:
            at = todo.pop()
            if isinstance(at, str):
                if at.strip():
                    yield at.strip()
            elif at.tag not in ("script", "style"):
                todo += reversed(at.children)

    def text(self, separator: str = "") -> str:
        return separator.join(self.strings())

    def drop(self) -> None:
        self.parent.children.remove(self)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        new = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(new)
        if tag not in _VOID:
            self.at = new

    def handle_endtag(self, tag: str) -> None:
        up = self.at
        while up is not self.root and up.tag != tag:
            up = up.parent
        if up is not self.root:
            self.at = up.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
