"""Flow extraction from (X)HTML: one pass over parser events, no tree in memory.

Block boundaries end a paragraph; ``br`` is a line end and an empty line splits; ``hr``, lines of ornaments and separator
classes are scene breaks, which hold only between two paragraphs of eight words or more; headings give chapter candidates; images are
anchored to the paragraph before them; ids are anchors of the paragraph that follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from leafmill.sources.files import flat_map

#: Elements by role.
IGNORED = {"script", "style", "noscript", "template", "head", "title"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "html", "legend", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "image"}
_SPACE = re.compile(r"\s+")
_ORNAMENT = "*⁂•◆◇◊❦❧·"
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SEPARATOR = re.compile(r"\b(?:scene-?break|section-?break|separator|divider|ornament|asterism|sep)\b", re.I)


def normalize(text: str) -> str:
    return _SPACE.sub(" ", text.replace("­", "")).strip()


def is_ornament(text: str) -> bool:
    text = normalize(text)
    if not text or any(c.isalnum() for c in text):
        return False
    return text in ("⁂", "❦", "❧") or (sum(c in _ORNAMENT for c in text) >= 3 and all(c in _ORNAMENT or c.isspace() or c in "—–_-" for c in text))


def word_count(text: str) -> int:
    return sum(1 for w in text.split() if w.strip("\"'"))


class Flow(HTMLParser):
    """Collects paragraphs, headings, images and anchors over one or more documents of a book."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.paragraphs: list[tuple[str, str | None]] = []
        self.headings: list[tuple[str, int, int]] = []
        self.images: list[tuple[int, str, str]] = []
        self.anchors: list[tuple[str, int]] = []
        self.begin()

    def begin(self) -> None:
        """Start the next document; what was collected stays."""
        self.reset()
        self.open: list[tuple[str, bool]] = []  # tag, and whether it hides its content
        self.hidden = 0
        self.buffer: list[str] = []
        self.carried = ""
        self.scene: str | None = None
        self.heading: tuple[int, int, list[str]] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = {k: v or "" for k, v in attrs}
        hides = tag in IGNORED or "hidden" in at or at.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(at.get("style", "")))
        if tag in VOID:
            if not self.hidden and not hides:
                self.single(tag, at)
            return
        if tag in BLOCKS and not self.hidden:
            self.flush()
        self.open.append((tag, hides))
        self.hidden += hides
        if self.hidden:
            return
        self.anchor(at)
        if tag in BLOCKS and _SEPARATOR.search(f"{at.get('class', '')} {at.get('id', '')} {at.get('role', '')}") and tag in ("div", "p"):
            self.separator = (len(self.open), len(self.paragraphs))
        if re.fullmatch("h[1-6]", tag) and not self.heading:
            self.heading = (len(self.open), len(self.paragraphs), [])
        if tag in ("svg", "object", "video") and (at.get("data") or at.get("poster")):
            self.picture(at.get("data") or at["poster"], at)

    separator: tuple[int, int] | None = None

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        if not self.hidden and any(t in BLOCKS for t, _ in self.open[at:]):
            self.flush()
        if self.heading and self.heading[0] > at:
            _, start, texts = self.heading
            title = normalize(" ".join(texts))
            if texts and 1 <= len(title) <= 240 and any(c.isalnum() for c in title):
                self.headings.append((title, start + 1, int(self.open[self.heading[0] - 1][0][1])))
            self.heading = None
        if self.separator and self.separator[0] > at:
            if self.separator[1] == len(self.paragraphs):
                self.broken("css-separator")
            self.separator = None
        self.hidden -= sum(h for _, h in self.open[at:])
        del self.open[at:]

    def single(self, tag: str, at: dict[str, str]) -> None:
        if tag == "br":
            self.buffer.append("\n")
        elif tag == "hr":
            self.flush()
            self.broken("horizontal-rule")
        elif tag in ("img", "image", "embed", "source"):
            src = at.get("src") or at.get("xlink:href") or at.get("href") or best_of(at.get("srcset", ""))
            if src:
                self.flush()
                self.picture(src, at)
        self.anchor(at)

    def picture(self, src: str, at: dict[str, str]) -> None:
        alt = normalize(at.get("alt") or at.get("aria-label") or at.get("title") or "")[:500]
        row = (len(self.paragraphs), src.strip(), alt)
        if not self.images or self.images[-1][:2] != row[:2]:
            self.images.append(row)

    def anchor(self, at: dict[str, str]) -> None:
        if name := at.get("id") or at.get("name") or at.get("xml:id"):
            self.anchors.append((name, len(self.paragraphs) + 1))

    def broken(self, source: str) -> None:
        if self.paragraphs and self.scene is None:
            self.scene = source

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.buffer.append(data)

    def flush(self) -> None:
        text, self.buffer = "".join(self.buffer), []
        for group in re.split(r"\n\s*\n+", text) if "\n\n" in text else [text]:
            line = normalize(group)
            if not line:
                continue
            if is_ornament(line):
                self.broken("text-ornament")
                continue
            if not any(c.isalnum() for c in line):
                self.carried = normalize(f"{self.carried} {line}")
                continue
            if self.carried:
                line, self.carried = normalize(self.carried + (" " if group[:1].isspace() else "") + line), ""
            good = self.scene and self.paragraphs and word_count(self.paragraphs[-1][0]) >= 8 and word_count(line) >= 8
            self.paragraphs.append((line, self.scene if good else None))
            self.scene = None
            if self.heading:
                self.heading[2].append(line)

    def finish(self) -> None:
        self.close()
        self.flush()


def best_of(srcset: str) -> str:
    """The URL of the largest descriptor; the first of equals."""
    best, most = "", -1.0
    for part in srcset.split(","):
        words = part.split()
        if words:
            m = re.fullmatch(r"([0-9.]+)[wx]", words[1]) if len(words) > 1 else None
            size = float(m[1]) if m else 1.0
            if size > most:
                best, most = words[0], size
    return best


def flow_rows(markup: str) -> Iterator[dict]:
    """Tagged rows of one document: paragraphs, headings, images, anchors."""
    flow = Flow()
    flow.feed(markup)
    flow.finish()
    for i, (text, scene) in enumerate(flow.paragraphs):
        yield {"kind": "paragraph", "seq": i, "paragraph_id": i + 1, "text": text, "extra": scene}
    for i, (title, start, level) in enumerate(flow.headings):
        yield {"kind": "heading", "seq": i, "paragraph_id": start, "text": title, "extra": str(level)}
    for i, (after, src, alt) in enumerate(flow.images):
        yield {"kind": "image", "seq": i, "paragraph_id": after, "text": alt, "extra": src}
    for i, (name, at) in enumerate(flow.anchors):
        yield {"kind": "anchor", "seq": i, "paragraph_id": at, "text": name, "extra": None}


ROWS = "kind string, seq int, paragraph_id int, text string, extra string"


def html_blocks(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """(key, kind, seq, paragraph_id, text, extra) of each page; a page that cannot be read gives one ``diagnostic`` row."""
    return flat_map(
        pages.select(key, column),
        f"`{key}` {pages.schema[key].dataType.simpleString()}, {ROWS}",
        lambda r: [{key: r[key], **x} for x in flow_rows(r[column] or "")],
        lambda r, e: {key: r[key], "kind": "diagnostic", "seq": 0, "paragraph_id": None, "text": f"{type(e).__name__}: {e}"[:500], "extra": "Crash / parse error"},
    )


def css_rules(css: str) -> Iterator[tuple[str, str]]:
    """(selector, declarations) of a style sheet, comments removed; nested blocks are left out."""
    for m in re.finditer(r"([^{}@;]+)\{([^{}]*)\}", re.sub(r"/\*.*?\*/", "", css, flags=re.S)):
        for one in m[1].split(","):
            if one.strip():
                yield one.strip(), m[2].strip()


def css_image_rules(css: str) -> list[tuple[str, str]]:
    """(selector, URL) of rules with a picture."""
    return [(s, m[2]) for s, d in css_rules(css) for m in [re.search(r"url\(\s*([\"']?)([^\"')]+)\1\s*\)", d)] if m]


def css_separators(css: str) -> list[str]:
    """Selectors of rules that draw a separator: named like one, or a rule above or below an empty box."""
    return [s for s, d in css_rules(css) if _SEPARATOR.search(s) or re.search(r"border-(?:top|bottom)\s*:[^;]*\b(?:solid|dashed|dotted|double)\b", d) and re.search(r"\bheight\s*:\s*0", d)]
