"""Reading of one HTML page: visible text and links with the text around them. A helper of the page jobs."""

from __future__ import annotations

import re
from html.parser import HTMLParser

HIDDEN = {"script", "style", "noscript", "nav", "footer"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Opening one of these ends an open element of the same set, as browsers read unclosed lists and paragraphs.
SELF_CLOSING_PEERS = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "option": {"option"}}
SPACE = re.compile(r"[ \t\n\r\f\v]+")
EDGE = " \t\n\r\0\v"


class _Page(HTMLParser):
    """Keeps all text in one list; an element is the span of list positions it covers."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden: list[bool] = []
        self.open: list[list] = []  # [tag, first part, link index or None]
        self.spans: list[tuple[int, int]] = []
        self.links: list[dict] = []
        self.hidden_depth = 0

    def handle_starttag(self, tag, attrs):
        peers = SELF_CLOSING_PEERS.get(tag)
        if peers and self.open and self.open[-1][0] in peers:
            self._close(len(self.open) - 1)
        link = None
        given = dict(attrs)
        target = {"a": given.get("href"), "iframe": given.get("src"), "embed": given.get("src")}.get(tag)
        if target is not None:
            link = len(self.links)
            self.links.append({"tag": tag, "href": target, "own": (len(self.parts), len(self.parts)), "around": []})
        if tag in VOID:
            if link is not None:
                self.links[link]["chain"] = list(self.open)
            return
        entry = [tag, len(self.parts), link, None]
        if link is not None:
            self.links[link]["chain"] = list(self.open)
        self.open.append(entry)
        if tag in HIDDEN:
            self.hidden_depth += 1

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                while len(self.open) > i:
                    self._close(len(self.open) - 1)
                return

    def _close(self, i: int) -> None:
        entry = self.open.pop(i)
        entry[3] = len(self.parts)
        if entry[2] is not None:
            self.links[entry[2]]["own"] = (entry[1], entry[3])
        if entry[0] in HIDDEN:
            self.hidden_depth -= 1

    def handle_data(self, data):
        self.parts.append(data)
        self.hidden.append(self.hidden_depth > 0)

    def finish(self) -> None:
        while self.open:
            self._close(len(self.open) - 1)


def _parse(html: str) -> _Page:
    page = _Page()
    page.feed(html)
    page.close()
    page.finish()
    return page


def page_text(html: str | None) -> str:
    """Visible text on one line."""
    if not html:
        return ""
    page = _parse(html)
    return SPACE.sub(" ", "".join(p for p, h in zip(page.parts, page.hidden) if not h)).strip(EDGE)


def page_links(html: str | None, with_near: bool = True) -> list[tuple[int, str, str, str, str]]:
    """(position, tag, href, link text, nearby text) of every anchor, frame and embed that has a target.

    Nearby text is that of the closest of three enclosing elements with over 20 bytes, whole.
    """
    if not html:
        return []
    page = _parse(html)
    out = []
    texts: dict[tuple[int, int], str] = {}
    for pos, link in enumerate(page.links):
        start, end = link["own"]
        near = ""
        for entry in list(reversed(link["chain"]))[:3] if with_near else []:
            span = (entry[1], entry[3])
            near = texts.get(span)
            if near is None:  # links of one element share its text
                near = texts[span] = SPACE.sub(" ", "".join(page.parts[entry[1]:entry[3]])).strip(EDGE)
            if len(near.encode()) > 20:
                break
        out.append((pos, link["tag"], link["href"], "".join(page.parts[start:end]).strip(EDGE), near))
    return out
