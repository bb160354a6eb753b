"""Main content by the standard library's parser, for comparison in tests."""

from __future__ import annotations

import re
from html.parser import HTMLParser

_SKIP_TAGS = {"script", "style", "head", "noscript", "template", "svg", "iframe"} | {"nav", "aside", "header", "footer", "menu"}
_SKIP_CLASSES = set("sidebar navigation filter widget widget-area sidebar-widget menu ad ads advert advertisement".split())
_VOID = {"br", "img", "meta", "link", "hr", "input", "source", "wbr", "area", "base", "col", "embed"}
_BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "li", "table", "tr", "blockquote"}


class _Renderer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.stack: list[tuple[str, bool]] = []  # (tag, opens a skipped region)
        self.skip_depth = 0
        self.link: list[str] | None = None
        self.href = ""
        self.n_links = 0
        self.n_headings = 0

    def _emit(self, s: str) -> None:
        if self.skip_depth:
            return
        if self.link is not None:
            self.link.append(s)
        else:
            self.out.append(s)

    def handle_starttag(self, tag, attrs):
        a = dict((k, v or "") for k, v in attrs)
        if tag == "p" and any(t == "p" for t, _ in self.stack):
            self._close("p")  # <p> inside an open <p> closes it
        if tag == "body" and any(t == "head" for t, _ in self.stack):
            self._close("head")  # </head> may be left out
        if tag in _VOID:
            if tag == "br":
                self._emit("\n")
            return
        classes = set((a.get("class", "") + " " + a.get("id", "")).lower().split())
        skip = tag in _SKIP_TAGS or bool(classes & _SKIP_CLASSES)
        self.stack.append((tag, skip))
        if skip:
            self.skip_depth += 1
            return
        if re.fullmatch(r"h[1-6]", tag):
            self.n_headings += not self.skip_depth
            self._emit("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self._emit("\n- ")
        elif tag in _BLOCK:
            self._emit("\n\n")
        elif tag == "a" and self.link is None and not self.skip_depth:
            self.link, self.href = [], a.get("href", "")

    def _close(self, tag: str) -> None:
        while self.stack:
            t, skip = self.stack.pop()
            if skip:
                self.skip_depth -= 1
            elif re.fullmatch(r"h[1-6]", t) or t in _BLOCK:
                self._emit("\n\n")
            elif t == "a" and self.link is not None:
                text = " ".join("".join(self.link).split())
                self.link = None
                if text:
                    self.n_links += 1
                    self.out.append(f"[{text}]({self.href})")
            if t == tag:
                return

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            self._close(tag)

    def handle_data(self, data):
        self._emit(data)


def render_markdown(html: str) -> tuple[str, int, int]:
    """Return (markdown, number of links, number of headings)."""
    r = _Renderer()
    r.feed(html)
    r.close()
    r._close("")
    text = "".join(r.out)
    text = re.sub(r"[ \t ]+", " ", text)
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", text)
    text = re.sub(r"\n{3,}", "\n\n", text)
    return text.strip(), r.n_links, r.n_headings
