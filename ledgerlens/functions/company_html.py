"""A company's name, sector and industry out of its web page, by a cascade of places where pages tell them."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_FOUND = "Not Found"


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += reversed(x.children)
        return "".join(out)

    def find(self, tag: str):
        """All elements below with the tag, in page order."""
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                if x.tag == tag:
                    yield x
                todo += reversed(x.children)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def _has(node: Node, name: str) -> bool:
    return name in node.attrs.get("class", "").split()


def _value(pattern: str, text: str, flags: int = 0) -> str | None:
    m = re.search(pattern, text, flags)
    return m[1].strip() if m else None


def company_fields(html: str) -> tuple[str, str, str, str]:
    """(name, sector, industry, status); what a page doesn't tell is 'Not Found'.

    Sector and industry are looked for among the peers, then, if there is no sector, in the whole text, then in table rows.
    """
    page = tree(html)
    name = next((x.text().strip() for x in page.find("h1") if _has(x, "company")), NOT_FOUND)
    got: dict[str, str] = {}
    peers = next((x for x in page.find("section") if x.attrs.get("id") == "peer-comparison"), None)
    info = next((x for x in peers.find("div") if _has(x, "company-info")), None) if peers else None
    if info:
        for what in ("Sector", "Industry"):
            if (v := _value(rf"{what}[:\s]+([^\n]+)", info.text())) is not None:
                got[what] = v
    if got.get("Sector", NOT_FOUND) == NOT_FOUND:
        whole = page.text()
        for what in ("Sector", "Industry"):
            for form in (rf"{what}\s*:\s*([^\n]+)", rf"{what}\s+([^\n]+)"):
                if got.get(what, NOT_FOUND) == NOT_FOUND and (v := _value(form, whole, re.IGNORECASE)) is not None:
                    got[what] = v
    for row in (r for t in page.find("table") for r in t.find("tr")):
        low = row.text().lower()
        what = next((w for w in ("Sector", "Industry") if w.lower() in low and got.get(w, NOT_FOUND) == NOT_FOUND), None)
        cells = list(row.find("td"))
        if what and len(cells) > 1:
            got[what] = cells[1].text().strip()
    sector, industry = got.get("Sector", NOT_FOUND), got.get("Industry", NOT_FOUND)
    return name, sector, industry, "No industry data found" if sector == industry == NOT_FOUND else "Found"
