"""Signals of one HTML page by the standard library's streaming parser: title, description, structured data, links, visible text."""

from __future__ import annotations

import json
from html.parser import HTMLParser
from urllib.parse import urljoin

HIDDEN = {"script", "style", "noscript", "template", "svg"}
BREAKS = {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol"}


class Page(HTMLParser):
    """Collects while the text streams by; nothing inside hidden elements counts as text or link."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.title, self.meta, self.data, self.links, self.text = url, "", {}, [], [], []
        self.hidden, self.in_title, self.json, self.open = 0, False, None, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in HIDDEN:
            self.hidden += 1
            self.json = [] if tag == "script" and (a.get("type") or "").lower() == "application/ld+json" else None
        elif tag == "title":
            self.in_title = True
        elif tag == "meta":
            name = (a.get("property") or a.get("name") or "").lower()
            if name and a.get("content"):
                self.meta.setdefault(name, a["content"])
        elif tag == "a" and a.get("href") and not self.hidden:
            self.open = [urljoin(self.url, a["href"].strip()), []]
        elif tag == "img" and self.open and a.get("alt"):
            self.open[1].append(a["alt"])
        if tag in BREAKS and not self.hidden:
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
            if self.json is not None:
                try:
                    self.data.append(json.loads("".join(self.json)))
                except ValueError:
                    pass
                self.json = None
        elif tag == "title":
            self.in_title = False
        elif tag == "a" and self.open:
            self.links.append((self.open[0], " ".join("".join(self.open[1]).split())))
            self.open = None
        if tag in BREAKS and not self.hidden:
            self.text.append("\n")

    def handle_data(self, data):
        if self.json is not None:
            self.json.append(data)
        elif self.in_title:
            self.title += data
        elif not self.hidden:
            self.text.append(data)
            if self.open:
                self.open[1].append(data)


def signals(html: str | None, url: str = "") -> dict:
    """title, description, site, data (structured), links (absolute, each once, the first text wins) and text of a page; empty for null."""
    p = Page(url or "")
    p.feed(html or "")
    p.close()
    links: dict[str, str] = {}
    for to, text in p.links:
        links.setdefault(to, text)
    lines = [" ".join(x.split()) for x in "".join(p.text).split("\n")]
    return {"title": " ".join(p.title.split()), "description": p.meta.get("og:description") or p.meta.get("description"), "site": p.meta.get("og:site_name"), "data": p.data, "links": links, "text": "\n".join(x for x in lines if x)}


def table_sections(html: str | None) -> list[tuple[str, list[str]]]:
    """(section, cells) of the rows of a page's tables; a row of one cell opens the section of those after it."""

    class Rows(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.rows, self.cell = [], None

        def handle_starttag(self, tag, attrs):
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th") and self.rows:
                self.cell = []

        def handle_endtag(self, tag):
            if tag in ("td", "th") and self.cell is not None:
                self.rows[-1].append(" ".join("".join(self.cell).split()))
                self.cell = None

        def handle_data(self, data):
            if self.cell is not None:
                self.cell.append(data)

    p = Rows()
    p.feed(html or "")
    p.close()
    out, section = [], ""
    for cells in p.rows:
        if len(cells) == 1:
            section = cells[0]
        elif cells:
            out.append((section, cells))
    return out
