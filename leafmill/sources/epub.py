"""EPUB packages: archive, container, package, spine, navigation and flow, as tagged rows of one pass over the bytes."""

from __future__ import annotations

import io
import posixpath
import re
import urllib.parse
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.sources.files import decode_markup, flat_map
from leafmill.sources.html import Flow, normalize

#: Limits of one archive and types of content documents.
ENTRY_BYTES, TOTAL_BYTES = 32 << 20, 96 << 20
CONTENT_TYPES = {"application/xhtml+xml", "text/html", "application/x-dtbook+xml", "application/xml", "text/xml"}
CONTENT_SUFFIX = (".xhtml", ".html", ".htm", ".xml")


class EpubError(ValueError):
    """A package that cannot be read; the bucket says why."""

    def __init__(self, bucket: str, message: str):
        super().__init__(message)
        self.bucket = bucket


class Archive:
    """Entries by exact, case-insensitive or decoded name; only what is asked for is inflated, within limits."""

    def __init__(self, content: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as e:
            raise EpubError("Crash / parse error", "not a readable ZIP archive") from e
        self.names = {i.filename: i for i in self.zip.infolist() if not i.is_dir()}
        self.lower = {n.lower(): n for n in reversed(list(self.names))}
        self.read_bytes = 0
        self.counted: set[str] = set()

    def resolve(self, path: str) -> str | None:
        for name in (path, urllib.parse.unquote(path)):
            name = posixpath.normpath(name).lstrip("/")
            found = name if name in self.names else self.lower.get(name.lower())
            if found:
                return found
        return None

    def read(self, path: str) -> bytes | None:
        name = self.resolve(path)
        if name is None:
            return None
        size = self.names[name].file_size
        self.read_bytes += 0 if name in self.counted else size
        self.counted.add(name)
        if size > ENTRY_BYTES or self.read_bytes > TOTAL_BYTES:
            raise EpubError("Other", f"{name} exceeds the archive limits")
        return self.zip.read(name)


def resolve_reference(base: str, href: str) -> tuple[str | None, str]:
    """(path, fragment) of a reference inside the archive; no path for external schemes."""
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", href):
        return None, ""
    path, _, fragment = href.partition("#")
    path = urllib.parse.unquote(path.partition("?")[0])
    full = posixpath.normpath(posixpath.join(posixpath.dirname(base), path)) if path else base
    return re.sub(r"^(?:\.\./)+", "", full).lstrip("/"), urllib.parse.unquote(fragment)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _all(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in root.iter() if _local(e) == name]


def _xml(data: bytes) -> ElementTree.Element:
    text = re.sub(r"<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>", "", decode_markup(data), flags=re.S)
    text = re.sub(r"^\s*<\?xml[^>]*\?>", "", text)
    text = re.sub(r"&(?!amp;|lt;|gt;|quot;|apos;|#)[a-zA-Z]+;", " ", text)
    try:
        return ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise EpubError("Crash / parse error", f"malformed XML: {e}") from e


def container(archive: Archive) -> str:
    """The package's path; the one typed as such before others."""
    data = archive.read("META-INF/container.xml")
    if data is None:
        raise EpubError("Crash / parse error", "no container.xml")
    roots = [e.attrib for e in _all(_xml(data), "rootfile") if e.attrib.get("full-path")]
    roots.sort(key=lambda a: a.get("media-type") != "application/oebps-package+xml")
    if not roots:
        raise EpubError("Crash / parse error", "no rootfile")
    return roots[0]["full-path"]


def fallback(item: dict, by_id: dict[str, dict]) -> dict:
    """The first content document along the fallback chain, the item itself if there is none; cycles end."""
    seen, now = set(), item
    while now and now["id"] not in seen:
        if now["type"] in CONTENT_TYPES or (now["path"] or "").lower().endswith(CONTENT_SUFFIX):
            return now
        seen.add(now["id"])
        now = by_id.get(now["fallback"])
    return item


def package(archive: Archive, path: str) -> dict:
    """Metadata, manifest, spine and pointers of an OPF package; fixed layouts are refused."""
    data = archive.read(path)
    if data is None:
        raise EpubError("Crash / parse error", "the package document is missing")
    root = _xml(data)
    meta = next(iter(_all(root, "metadata")), ElementTree.Element("none"))
    texts = lambda name: [t for e in meta.iter() if _local(e) == name and (t := normalize("".join(e.itertext())))]
    metas = [(e.attrib, normalize(e.attrib.get("content") or "".join(e.itertext()))) for e in meta.iter() if _local(e) == "meta"]
    for a, value in metas:
        name = (a.get("property") or a.get("name") or "").lower()
        if (name, value.lower()) == ("rendition:layout", "pre-paginated") or name == "fixed-layout" and value.lower() in ("true", "yes", "1"):
            raise EpubError("Other", "fixed layout")
    manifest = []
    for e in _all(root, "item"):
        if e.attrib.get("id", "").strip() and e.attrib.get("href", "").strip():
            target, _ = resolve_reference(path, e.attrib["href"].strip())
            manifest.append({"id": e.attrib["id"].strip(), "path": (archive.resolve(target) or target) if target else None, "type": e.attrib.get("media-type", "").strip().lower(), "properties": set(e.attrib.get("properties", "").lower().split()), "fallback": e.attrib.get("fallback", "").strip()})
    if not manifest:
        raise EpubError("Crash / parse error", "the manifest is empty")
    by_id: dict[str, dict] = {}
    for item in manifest:
        by_id.setdefault(item["id"], item)
    spine_element = next(iter(_all(root, "spine")), ElementTree.Element("none"))
    missing, spine = [], []
    for e in _all(spine_element, "itemref"):
        ref = e.attrib.get("idref", "").strip()
        if ref in by_id:
            spine.append((fallback(by_id[ref], by_id), e.attrib.get("linear", "yes").lower() != "no"))
        else:
            missing.append(ref)
    if not spine:
        raise EpubError("Crash / parse error", "the spine is empty")
    covers = [i["path"] for i in manifest if "cover-image" in i["properties"]]
    covers += [by_id[v]["path"] for a, v in metas if a.get("name", "").lower() == "cover" and v in by_id]
    covers += [p for e in _all(root, "reference") if "cover" in e.attrib.get("type", "").lower().split() for p, _ in [resolve_reference(path, e.attrib.get("href", ""))] if p]
    covers += [i["path"] for i in manifest if i["type"].startswith("image/") and "cover" in f"{i['id']} {i['path']}".lower()]
    toc = by_id.get(spine_element.attrib.get("toc", "").strip()) or next((i for i in manifest if i["type"] == "application/x-dtbncx+xml"), None)
    return {"title": (texts("title") or [""])[0], "authors": texts("creator"), "language": (texts("language") or [""])[0], "identifier": (texts("identifier") or [""])[0], "manifest": manifest, "spine": spine, "missing": missing, "covers": [c for c in covers if c], "nav": next((i for i in manifest if "nav" in i["properties"]), None), "ncx": toc, "images": sum(i["type"].startswith("image/") for i in manifest), "duplicates": len(manifest) - len(by_id)}


def nav_entries(root: ElementTree.Element) -> Iterator[tuple[str, str, int]]:
    """(title, href, depth) of the table of contents in an EPUB 3 navigation document."""
    navs = _all(root, "nav")
    navs.sort(key=lambda n: "toc" not in " ".join(v for k, v in n.attrib.items() if k.rpartition("}")[2] in ("type", "role", "id")).lower())

    def walk(e: ElementTree.Element, depth: int) -> Iterator[tuple[str, str, int]]:
        for child in e:
            name = _local(child)
            if name == "a":
                yield normalize("".join(child.itertext())), child.attrib.get("href", ""), depth
            else:
                yield from walk(child, depth + (name == "ol"))

    if navs:
        yield from walk(navs[0], 0)


def ncx_entries(root: ElementTree.Element) -> Iterator[tuple[str, str, int]]:
    """(title, src, depth) of the points of an EPUB 2 NCX."""

    def walk(e: ElementTree.Element, depth: int) -> Iterator[tuple[str, str, int]]:
        for p in e:
            if _local(p) == "navPoint":
                label = next((normalize("".join(x.itertext())) for x in p if _local(x) == "navLabel"), "")
                src = next((x.attrib.get("src", "") for x in p if _local(x) == "content"), "")
                yield label, src, depth
                yield from walk(p, depth + 1)

    for m in _all(root, "navMap"):
        yield from walk(m, 1)


def _row(kind: str, seq: int, text: str | None = None, extra: str | None = None, paragraph_id: int | None = None, path: str | None = None) -> dict:
    return {"kind": kind, "seq": seq, "paragraph_id": paragraph_id, "text": text, "extra": extra, "path": path}


def viable(flow: Flow) -> bool:
    """Whether the paragraphs make a readable text: 50 words and 150 letters."""
    text = " ".join(p for p, _ in flow.paragraphs)
    return len(text.split()) >= 50 and sum(map(str.isalpha, text)) >= 150


def flowed(archive: Archive, items: list[dict]) -> tuple[Flow, list[tuple[str, int]], list[dict]]:
    """The documents of a reading order as one flow, where each file with text starts, and rows of their anchors, images, files and faults."""
    flow, files, rows = Flow(), [], []
    for item in items:
        data = archive.read(item["path"]) if item["path"] else None
        if data is None:
            rows.append(_row("diagnostic", 0, f"missing spine document: {item['path']}", "Other"))
            continue
        n, heads, anchors, images = len(flow.paragraphs), len(flow.headings), len(flow.anchors), len(flow.images)
        flow.begin()
        flow.feed(decode_markup(data))
        flow.finish()
        for i in range(anchors, len(flow.anchors)):
            rows.append(_row("anchor", i, flow.anchors[i][0], None, flow.anchors[i][1], item["path"]))
        for i in range(images, len(flow.images)):
            after, src, alt = flow.images[i]
            target = src if src.startswith("data:") else resolve_reference(item["path"], src)[0]
            if target:
                rows.append(_row("image", i, alt, target, after, item["path"]))
        if len(flow.paragraphs) > n:
            title = flow.headings[heads][0] if len(flow.headings) > heads else posixpath.splitext(posixpath.basename(item["path"]))[0]
            files.append((item["path"], n + 1))
            rows.append(_row("file", len(files) - 1, title, None, n + 1, item["path"]))
    return flow, files, rows


def epub_rows(content: bytes) -> Iterator[dict]:
    """Tagged rows of a book: metadata, paragraph, heading, image, anchor, file, nav, ncx, cover, diagnostic."""
    row = _row
    archive = Archive(content)
    opf = container(archive)
    book = package(archive, opf)
    for k in ("title", "language", "identifier"):
        if book[k]:
            yield row("metadata", 0, book[k], k)
    for i, a in enumerate(book["authors"]):
        yield row("metadata", i, a, "author")
    yield row("metadata", 0, str(book["images"]), "declared_images")
    for i, ref in enumerate(book["missing"]):
        yield row("diagnostic", i, f"Spine idref is absent from the manifest: {ref or '(empty)'}", "Other")
    if book["duplicates"]:
        yield row("diagnostic", 0, f"{book['duplicates']} duplicate manifest ids", "Other")
    # a navigation document in the spine would repeat its labels as text
    spine = [(i, on) for i, on in book["spine"] if i is not book["nav"]]
    every, linear = [i for i, _ in spine], [i for i, on in spine if on]
    flow, files, found = flowed(archive, linear or every)
    if linear and len(linear) < len(every) and not viable(flow):
        # a cover alone may be linear while the text is not; a short linear story takes in no auxiliary text that is not viable itself
        whole = flowed(archive, every)
        if viable(whole[0]):
            flow, files, found = whole
    yield from found
    for i, (text, scene) in enumerate(flow.paragraphs):
        yield row("paragraph", i, text, scene, i + 1)
    for i, (title, start, level) in enumerate(flow.headings):
        yield row("heading", i, title, str(level), start)
    for kind, item, entries in (("nav", book["nav"], nav_entries), ("ncx", book["ncx"], ncx_entries)):
        data = archive.read(item["path"]) if item and item["path"] else None
        if data is not None:
            for i, (title, href, depth) in enumerate(entries(_xml(data))):
                target, fragment = resolve_reference(item["path"], href)
                if target:
                    yield row(kind, i, title, fragment, depth, archive.resolve(target) or target)
    for i, c in enumerate(dict.fromkeys(book["covers"])):
        yield row("cover", i, c)


SCHEMA = "kind string, seq int, paragraph_id int, text string, extra string, path string"


def read_epubs(files: DataFrame, key: str = "path") -> DataFrame:
    """Tagged rows of each file's ``content``; unreadable books give one diagnostic row with their bucket."""
    kind = files.schema[key].dataType.simpleString()
    return flat_map(
        files.select(F.col(key).alias("book"), "content"),
        f"book {kind}, {SCHEMA}",
        lambda r: [{"book": r["book"], **x} for x in epub_rows(r["content"])],
        lambda r, e: {"book": r["book"], "kind": "diagnostic", "seq": 0, "paragraph_id": None, "text": str(e)[:500], "extra": getattr(e, "bucket", "Crash / parse error"), "path": None},
    )


def toc_targets(toc: DataFrame, anchors: DataFrame, files: DataFrame, counts: DataFrame, key: str = "book") -> DataFrame:
    """Each entry's paragraph: its anchor, its anchor regardless of case (the first registered), its file's start, else null; within 1..N.

    ``toc``: key, ord, title, path, fragment; ``anchors``: key, path, fragment, paragraph_id, pos; ``files``: key, path, paragraph_id; ``counts``: key, n.
    """
    exact = anchors.groupBy(key, "path", "fragment").agg(F.min_by("paragraph_id", "pos").alias("by_anchor"))
    loose = anchors.groupBy(key, F.lower("path").alias("lp"), F.lower("fragment").alias("lf")).agg(F.min_by("paragraph_id", "pos").alias("by_case"))
    starts = files.groupBy(key, "path").agg(F.min("paragraph_id").alias("by_file"))
    at = toc.withColumns({"lp": F.lower("path"), "lf": F.lower("fragment")}).join(exact, [key, "path", "fragment"], "left").join(loose, [key, "lp", "lf"], "left").join(starts, [key, "path"], "left").join(counts, key, "left")
    found = F.coalesce(F.when(F.col("fragment") != "", F.coalesce("by_anchor", "by_case")), "by_file")
    return at.select(key, "ord", "title", F.when(found.isNotNull(), F.greatest(F.lit(1), F.least(found, F.col("n")))).alias("start_paragraph_id"))


def cleaned(entries: DataFrame, counts: DataFrame, key: str = "book") -> DataFrame:
    """Sane titles, starts in range, the first of each (title, start). ``entries``: key, source, ord, title, start_paragraph_id."""
    at = entries.where("start_paragraph_id IS NOT NULL").join(counts, key).select(key, "source", "ord", T.normalize_text("title").alias("title"), F.greatest(F.lit(1), F.least(F.col("n"), F.col("start_paragraph_id"))).alias("start_paragraph_id")).where(T.sane_title("title"))
    first = at.groupBy(key, "source", F.lower("title").alias("lt"), "start_paragraph_id").agg(F.min_by(F.struct("ord", "title"), "ord").alias("f"))
    return first.select(key, "source", "f.ord", "f.title", "start_paragraph_id")


def choose_source(entries: DataFrame, books: DataFrame, key: str = "book") -> DataFrame:
    """(key, source, collapsed): nav, ncx, headings, files or single, by how far each list's starts are spread; and whether a table of contents had too few.

    ``entries`` as ``cleaned`` gives them; ``books``: key. One aggregate a book, then one expression.
    """
    facts = entries.groupBy(key, "source").agg(F.count("*").alias("n"), F.count_distinct("start_paragraph_id").alias("starts")).groupBy(key).pivot("source", ["nav", "ncx", "headings", "files"]).agg(F.first("n").alias("n"), F.first("starts").alias("s"))
    f = books.join(facts, key, "left").na.fill(0)
    flat = lambda x: (F.col(f"{x}_n") >= 4) & (F.col(f"{x}_s") / F.greatest(F.col(f"{x}_n"), F.lit(1)) < 0.4)
    nav = ~flat("nav") & (F.col("nav_n") > 0) & (flat("ncx") | (F.col("ncx_s") <= 1) | (F.col("nav_s") >= F.ceil(F.col("ncx_s") / 2)))
    ncx = ~flat("ncx") & (F.col("ncx_n") > 0) & (~flat("nav") | (F.col("ncx_s") >= 2) | (F.col("headings_n") == 0))
    source = F.when(nav, "nav").when(ncx, "ncx").when(F.col("headings_n") > 0, "headings").when(F.col("files_n") > 0, "files").otherwise("single")
    return f.select(key, source.alias("source"), (flat("nav") | flat("ncx")).alias("collapsed"))
