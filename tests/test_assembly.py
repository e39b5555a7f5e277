"""Chapters chosen from packages, books numbered anew, trees of contents: fixed cases."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.operators import assembly as A
from leafmill.operators.prefix import running_sum
from leafmill.sources import epub

PROSE = " ".join(f"Word{i} follows another in a sentence of some length." for i in range(12))


def package(docs, nav=None, title="The Book"):
    """An EPUB of (name, linear, body) documents."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/p.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        items = "".join(f'<item id="i{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, (n, _, _) in enumerate(docs))
        refs = "".join(f'<itemref idref="i{i}" linear="{"yes" if on else "no"}"/>' for i, (_, on, _) in enumerate(docs))
        toc = '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' if nav else ""
        z.writestr("OPS/p.opf", f'<package><metadata><title>{title}</title></metadata><manifest>{items}{toc}</manifest><spine>{refs}{"<itemref idref='nav'/>" if nav else ""}</spine></package>')
        if nav:
            links = "".join(f'<li><a href="{h}">{t}</a></li>' for t, h in nav)
            z.writestr("OPS/nav.xhtml", f'<html xmlns:epub="e"><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>')
        for n, _, body in docs:
            z.writestr(f"OPS/{n}", f"<html><body>{body}</body></html>")
    return out.getvalue()


def made(spark, **books):
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in books.items()], "path string, content binary")
    return A.epub_books(epub.read_epubs(files))


def test_navigation_becomes_chapters(spark):
    docs = [("a.xhtml", True, f"<h1>One</h1><p>{PROSE}</p><p>* * *</p><p>{PROSE}</p><img src='x.png' alt='A  map'/>"), ("b.xhtml", True, f"<h1 id='two'>Two</h1><p>{PROSE}</p>")]
    books, diagnostics = made(spark, good=package(docs, nav=[("First", "a.xhtml"), ("Second", "b.xhtml#TWO"), ("", "a.xhtml"), ("First", "a.xhtml")]))
    assert [(r["title"], r["start_paragraph_id"], r["chapter_index"]) for r in books.chapters.orderBy("chapter_index").collect()][0] == ("First", 1, 0)
    chapters = {r["title"]: r["start_paragraph_id"] for r in books.chapters.collect()}
    text = {r["id"]: r["text"] for r in books.paragraphs.collect()}
    assert list(chapters) == ["First", "Second"] and text[chapters["Second"]] == "Two"
    totals = books.totals.first()
    assert totals["paragraphs"] == len(text) == max(text) and totals["chapters"] == 2 and totals["images"] == 1 and totals["scene_breaks"] == 1
    assert books.images.first()["alt"] == "A map" and not [r for r in diagnostics.collect() if r["bucket"] == A.BUCKET]


def test_headings_stand_in(spark):
    docs = [("a.xhtml", True, f"<h1>One</h1><p>{PROSE}</p><h1>Two</h1><p>{PROSE}</p>")]
    books, diagnostics = made(spark, plain=package(docs), bare=package([("c.xhtml", True, f"<p>{PROSE}</p>")], title=""))
    got = {(r["book"], r["title"]) for r in books.chapters.collect()}
    assert {("plain", "One"), ("plain", "Two")} <= got and ("bare", "c") in got
    said = {r["book"]: (r["severity"], r["message"][:35]) for r in diagnostics.collect()}
    assert said["plain"] == ("warning", "Navigation TOC was unavailable; hea") and said["bare"][0] == "failure"


def test_second_extraction_only_where_the_first_is_not_viable(spark):
    cover, text, short = ("c.xhtml", True, "<p>A cover.</p>"), ("t.xhtml", False, f"<p>{PROSE}</p>"), ("s.xhtml", False, "<p>Only a note.</p>")
    books, _ = made(spark, wrapped=package([cover, text]), story=package([cover, short]), whole=package([("d.xhtml", True, f"<p>{PROSE}</p>"), short]))
    n = {r["book"]: r["paragraphs"] for r in books.totals.collect()}
    assert n == {"wrapped": 2, "story": 1, "whole": 1}


def test_unreadable_files_have_no_book(spark):
    books, diagnostics = made(spark, broken=b"PK", good=package([("d.xhtml", True, f"<p>{PROSE}</p>")]))
    assert [r["book"] for r in books.totals.collect()] == ["good"] and "broken" in {r["book"] for r in diagnostics.collect()}


def test_numbers_close_up(spark):
    p = spark.createDataFrame([("b", 10, "One", "x"), ("b", 20, " ­ ", "x"), ("b", 30, "Two", "x"), ("b", 9000, "Three", "x"), ("b", 9001, "Four", "x")], "book string, place long, text string, scene string")
    c = spark.createDataFrame([("b", 1, "Chapter A", 15), ("b", 2, "chapter  a", 30), ("b", 3, "Late", 99_999), ("b", 4, "x" * 241, 10), ("b", 5, "Preface", 9000), ("b", 6, "Chapter B", 9000)], "book string, ord int, title string, place long")
    i = spark.createDataFrame([("b", 1, "a", "s", 5), ("b", 2, None, "s", 25), ("b", 3, "a", "s", 10**6)], "book string, ord int, alt string, src string, place long")
    a = spark.createDataFrame([("b", "f", "x", 20), ("b", "f", "end", 10**6)], "book string, path string, fragment string, place long")
    b = A.build_books(spark.createDataFrame([("b",), ("empty",)], "book string"), p, c, i, a)
    assert [(r["id"], r["text"], r["scene"]) for r in b.paragraphs.orderBy("id").collect()] == [(1, "One", None), (2, "Two", None), (3, "Three", None), (4, "Four", "x")]
    assert [(r["title"], r["start_paragraph_id"]) for r in b.chapters.orderBy("chapter_index").collect()] == [("Chapter A", 2), ("Preface", 3), ("Chapter B", 3), ("Late", 4)]
    assert {r["ord"]: r["after_paragraph_id"] for r in b.images.collect()} == {1: 0, 2: 1, 3: 4}
    assert {r["fragment"]: r["paragraph_id"] for r in b.anchors.collect()} == {"x": 2, "end": 4}
    assert {r["book"]: (r["paragraphs"], r["chapters"], r["scene_breaks"]) for r in b.totals.collect()} == {"b": (4, 4, 1), "empty": (0, 0, 0)}


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_running_sum(spark, block):
    rows = [(k, i * 3 % 101, i) for k in ("a", "b") for i in range(101)]
    df = spark.createDataFrame(rows, "k string, place long, v long").repartition(3)
    got = {(r["k"], r["place"]): r["s"] for r in running_sum(df, "k", "place", [], F.col("v"), "s", block).collect()}
    for k in ("a", "b"):
        total = 0
        for place, v in sorted((p, v) for q, p, v in rows if q == k):
            total += v
            assert got[k, place] == total


def test_ragged_depths(spark):
    depths = [1, 3, 5, 3, 2, 7, 1, 4, 0, 9]
    got = [tuple(r) for r in A.outline_tree(spark.createDataFrame([("b", i * 2, d) for i, d in enumerate(depths)], "book string, ord int, depth int")).orderBy("ord").select("parent_ord", "last_ord").collect()]
    want = []
    for i, d in enumerate(depths):
        parent = max((j for j in range(i) if depths[j] < d), default=None)
        end = min((j for j in range(i + 1, len(depths)) if depths[j] <= d), default=len(depths))
        want.append((None if parent is None else parent * 2, (end - 1) * 2))
    assert got == want


def test_flat_outline(spark):
    rows = [(1, None, 2, "B", "d"), (2, None, 1, "A", "d"), (3, 1, 1, " B  1 ", "d"), (4, 3, 1, "deep", None), (5, 4, 0, "deeper", "d"), (6, 1, 0, "OLE_LINK4", "d"), (7, 8, 1, "ring", "d"), (8, 7, 1, "ring", "d"), (9, 99, 1, "lost", "d"), (10, 2, 1, "x" * 241, "d")]
    rows += [(100 + i, 99 + i if i else None, 5, f"chain {i}", "d") for i in range(40)]
    got = A.outline_flatten(spark.createDataFrame([("b", *r) for r in rows], "book string, id int, parent int, position int, title string, destination string")).orderBy("ord").collect()
    assert [(r["title"], r["depth"]) for r in got[:4]] == [("A", 1), ("B", 1), ("B 1", 2), ("deeper", 4)]
    assert [(r["title"], r["depth"], r["ord"]) for r in got[4:]] == [(f"chain {i}", i + 1, 5 + i) for i in range(40)]
