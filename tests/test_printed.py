"""Positioned text: fixed pages and books for joins over pages, headings, scenes, images, outlines and chapters inside prose."""

import io
from contextlib import redirect_stdout

import pytest

from leafmill.operators import pdf_text as D
from leafmill.plans.catalog import QUERIES

DRAFT = f"book_id string, page long, para long, heading string, text string, lines array<{D.LINE}>"
PROSE = "It was a long way to the sea and back again that day."


def line(text, baseline, col=0, size=10.0):
    return (text, col, float(baseline), size, 0.0, 100.0)


def draft(page, para, text, heading=None, baseline=0.0):
    return ("b", page, para, heading, text, [line(text, baseline)])


@pytest.mark.parametrize("name", ["merged_pages", "image_anchors", "outline_starts", "embedded_headings", "printed_scene_breaks", "built_book_parts", "toc_parents"])
def test_no_theta_joins(spark, sf, name):
    out = io.StringIO()
    with redirect_stdout(out):
        QUERIES[name](spark, sf).explain()
    assert "NestedLoop" not in out.getvalue() and "Cartesian" not in out.getvalue()


def test_page_joins_look_at_one_narrow_row_a_page(spark):
    rows = [draft(1, 0, "One whole."), draft(1, 1, "A word bro-"), draft(2, 0, "ken over three"), draft(3, 0, "pages ends here."), draft(3, 1, "then, after,"), draft(5, 0, "Comma carries on"), draft(6, 0, "Not this"), draft(7, 0, "heading", "strong"), draft(8, 0, "nor this")]
    df = spark.createDataFrame(rows, DRAFT)
    got = [(r["page"], r["para"], r["text"], len(r["lines"])) for r in D.merge_pages(df).orderBy("page", "para").collect()]
    assert got == [(1, 0, "One whole.", 1), (1, 1, "A word broken over three pages ends here.", 3), (3, 1, "then, after, Comma carries on", 2), (6, 0, "Not this", 1), (7, 0, "heading", 1), (8, 0, "nor this", 1)]
    out = io.StringIO()
    with redirect_stdout(out):
        D.merge_pages(df).explain("formatted")
    windows = [x for x in out.getvalue().split("\n\n") if "Window" in x.split("\n")[0]]
    assert windows and not any("lines" in x for x in windows)


def test_headings_join(spark):
    rows = [draft(1, 0, "The Long", "typographic", 0), draft(1, 1, "Voyage Home", "strong", 14), draft(1, 2, "Chapter 2", "strong", 28), draft(1, 3, "far below", "strong", 200), draft(1, 4, PROSE, None, 214), draft(2, 0, "Alone", "strong", 0)]
    got = [(r["page"], r["para"], r["heading"], r["text"]) for r in D.merge_headings(spark.createDataFrame(rows, DRAFT), spark.createDataFrame([("b", 1, 12.0)], "book_id string, page long, typical double")).orderBy("page", "para").collect()]
    assert got == [(1, 0, "strong", "The Long Voyage Home"), (1, 2, "strong", "Chapter 2"), (1, 3, "strong", "far below"), (1, 4, None, PROSE), (2, 0, "strong", "Alone")]


def test_scenes(spark):
    def para(i, *texts, page=1, at=None, heading=None):
        at = i * 100 if at is None else at
        return ("b", i, page, heading, " ".join(texts), [line(t, at + 12 * k) for k, t in enumerate(texts)])

    rows = [
        para(1, "* * *"),  # nothing before it: consumed without effect
        para(2, PROSE, PROSE),
        para(3, "* * *"),
        para(4, "***"),
        para(5, PROSE),  # after ornaments
        para(6, "***", "Three words here"),  # first line
        para(7, "Three more words", "⁂"),  # last line
        para(8, PROSE),  # marked by the line before
        para(9, PROSE, "• • •", PROSE),  # inside
        para(10, PROSE + " " + "* " * 16 + PROSE),  # a long run in one line
        para(11, PROSE, at=1012),  # on the same rhythm
        para(12, PROSE, at=1100),  # a wide gap
        para(13, PROSE, at=1300, heading="strong"),
        para(14, PROSE, at=1500),  # beside a heading
        para(15, PROSE, page=2, at=10),
        para(16, "***"),  # nothing behind it
    ]
    df = spark.createDataFrame(rows, f"book_id string, id long, page long, heading string, text string, lines array<{D.LINE}>")
    got = {(r["id"], r["part"]): (r["scene"], len(r["lines"])) for r in D.scene_breaks(df).collect()}
    orn = "text-ornament"
    assert got == {(2, 0): (None, 2), (5, 0): (orn, 1), (6, 0): (orn, 1), (7, 0): (None, 1), (8, 0): (orn, 1), (9, 0): (None, 1), (9, 1): (orn, 1), (10, 0): (None, 1), (10, 1): (orn, 1), (11, 0): (None, 1), (12, 0): ("whitespace", 1), (13, 0): (None, 1), (14, 0): (None, 1), (15, 0): (None, 1)}


def test_images(spark):
    lines = [("b", 1, 4, 0, 100.0, 0.0, 10.0), ("b", 1, 5, 1, 200.0, 0.0, 200.0), ("b", 1, 6, 2, 150.0, 300.0, 490.0), ("b", 2, 7, 1, 300.0, 0.0, 100.0)]
    images = [("b", 1, 1, 400.0, 250.0, 500.0), ("b", 1, 2, 100.0, 250.0, 500.0), ("b", 1, 3, 100.0, 50.0, 500.0), ("b", 2, 4, 100.0, 300.0, 500.0), ("b", 2, 5, 400.0, 900.0, 500.0), ("b", 4, 6, 9.0, 9.0, 500.0), ("c", 1, 7, 1.0, 1.0, 500.0), ("b", 1, 8, 250.0, 200.0, 500.0), ("b", 1, 9, 250.5, 140.0, 500.0)]
    got = D.image_anchors(spark.createDataFrame(images, "book_id string, page long, image_id long, x double, y double, width double"), spark.createDataFrame(lines, "book_id string, page long, paragraph_id long, col int, baseline double, x_min double, x_max double"))
    assert {r["image_id"]: r["after_paragraph_id"] for r in got.collect()} == {1: 6, 2: 5, 3: 0, 4: 7, 5: 6, 6: 7, 7: 0, 8: 6, 9: 4}


def test_outline_ties_and_gaps(spark):
    lines = spark.createDataFrame([("b", 1, 3, 10.0), ("b", 1, 2, 10.0), ("b", 1, 5, 20.0), ("b", 1, 5, 40.0), ("b", 1, 6, 30.0)], "book_id string, page long, paragraph_id long, baseline double")
    heads = spark.createDataFrame([("b", 1, 5, "Chapter The Sea"), ("b", 1, 6, "one two three four five")], "book_id string, page long, paragraph_id long, title string")
    items = [(1, "the  SEA", 1, 0.0), (2, "one two three four", 1, 0.0), (3, "x", 1, 15.0), (4, "x", 1, 25.0), (5, "x", 1, None), (6, "x", 9, 1.0), (7, "x", 1, 99.0), (8, "x", 1, -5.0)]
    got = {r["ord"]: (r["start"], r["matched"]) for r in D.outline_starts(spark.createDataFrame([("b", *i) for i in items], "book_id string, ord long, title string, page long, y double"), heads, lines).collect()}
    assert got == {1: (5, True), 2: (6, True), 3: (2, False), 4: (5, False), 5: (2, False), 7: (5, False), 8: (2, False)}


def book(*texts):
    return [("b", i + 1, None, t) for i, t in enumerate(texts)]


def pieces(spark, rows):
    return [(r["para"], r["heading"], r["text"]) for r in D.embedded_headings(spark.createDataFrame(rows, "book_id string, para int, heading string, text string")).orderBy("para", "piece").collect()]


def test_two_competing_runs(spark):
    """A run of three that is wide loses to one of four; the contents before it give titles and go."""
    fill = "Some words of prose that fill the page. " * 8
    rows = book("Contents Chapter 1 The Sea Chapter 2 The Land Chapter 3 The Sky Chapter 4 Home", f"Note chapter 1 {fill}", f"Then chapter 2 {fill}", f"and chapter 3 {fill}", f"End. * * * Chapter 1 The sea It began {fill}", fill, f"{fill} chapter two the LAND", f"x chapter III {fill}", f"chapter 9 out of turn {fill}", f"chapter 4 home. {fill}")
    got = pieces(spark, rows)
    assert [t for _, h, t in got if h] == ["Chapter 1 The sea", "chapter two", "chapter III", "chapter 4"]  # the last title would end beyond the contents
    assert got[0][:2] == (2, None) and ("Contents" not in " ".join(t for _, _, t in got)) and (5, None, "End.") in got
    short = pieces(spark, book("Chapter 1 a", "Chapter 2 b", "Chapter 3 c"))
    assert [t for _, _, t in short] == ["Chapter 1 a", "Chapter 2 b", "Chapter 3 c"]  # too narrow


def test_marker_over_a_line_end(spark):
    fill = "Some words of prose that fill the page. " * 20
    got = pieces(spark, book(f"{fill}chapter", f"1 begins {fill}", f"Chapter 2 {fill}", f"Chapter 3 {fill}"))
    assert [t for _, h, t in got if h] == ["chapter 1", "Chapter 2", "Chapter 3"] and got[2][2].startswith("begins")


def test_printed_chapters(spark):
    books = spark.createDataFrame([("good", "G", 100, 5, 3), ("weak", "W", 100, 20, 10), ("none", "N", 10, 20, 0)], "book_id string, title string, paragraphs int, pages int, items int")
    outline = spark.createDataFrame([("good", 1, "A", 1, True), ("good", 2, "B", 50, True), ("weak", 1, "Cover Front", 1, False)], "book_id string, ord int, title string, start int, matched boolean")
    heads = spark.createDataFrame([("weak", f"Chapter {i}", i * 20, 1.0, True) for i in (1, 2, 3)] + [("weak", "Other", 9, 2.0, False), ("weak", "Preface", 2, 1.0, False), ("good", "C", 3, 2.0, True)], "book_id string, title string, start int, prominence double, strong boolean")
    chapters, said = D.choose_chapters(books, outline, heads)
    assert sorted((r["book_id"], r["title"], r["start"]) for r in chapters.collect()) == [("good", "A", 1), ("good", "B", 50), ("none", "N", 1), ("weak", "Chapter 1", 20), ("weak", "Chapter 2", 40), ("weak", "Chapter 3", 60), ("weak", "Preface", 2)]
    assert sorted((r["book_id"], r["severity"], r["message"][:9]) for r in said.collect()) == [("none", "failure", "Long PDF "), ("none", "failure", "PDF has n"), ("weak", "warning", "Only 1 of"), ("weak", "warning", "Weak PDF ")]


def test_heading_kinds(spark):
    from pyspark.sql import functions as F

    body, large = 10.0, 12.0
    rows = [("Chapter 1", body, "strong"), ("chapter I summarize what came before", body, None), ("Chapter I: The Sea", body, "strong"), ("part two - on", body, "strong"), ("Prologue", body, "strong"), ("Introduction to it all", body, None), ("Introduction to it all", large, "strong"), ("12. the sea", large, "strong"), ("12. the sea", body, None), ("THE SEA", body, "typographic"), ("The sea", large, "typographic"), ("The sea", body, None), ("Contents ..... 4", large, None), ("", large, None), ("w " * 21, large, None), ("Appendix B", body, "strong"), ("ÜBER ALLES", body, "typographic")]
    df = spark.createDataFrame(rows, "t string, size double, want string")
    kind = D.heading_kind(F.col("t"), F.lit(0.0), F.lit(20.0), F.col("size"), F.lit(200.0), F.lit(body))
    assert [tuple(r) for r in df.withColumn("got", kind).where(~F.col("got").eqNullSafe(F.col("want"))).collect()] == []
    assert [r["b"] for r in spark.createDataFrame([("Chapter 1.",), ("chapter one",), ("Chapter 1: x",), ("Chapters",)], "t string").select(D.bare_heading(F.col("t")).alias("b")).collect()] == [True, True, False, False]


def test_unreadable_books(spark):
    pages = spark.createDataFrame([("scan", p, False, 1, 0, 0) for p in range(4)] + [("side", 1, True, 0, 100, 30)] + [("odd", 1, True, 0, 5, 0)] + [("thin", p, p == 1, 0, 5, 0) for p in range(1, 9)], "book_id string, page int, has_text boolean, images int, items int, vertical_items int")
    texts = spark.createDataFrame([("side", PROSE * 9), ("odd", PROSE * 9 + "�" * 12), ("thin", PROSE * 3), ("none", "no pages")], "book_id string, text string")
    got = sorted((r["book_id"], r["code"], r["message"][:12]) for r in D.quality_diagnostics(texts, pages).collect())
    assert got == [("odd", "garbled_text", "Extracted PD"), ("scan", "unusable_text", "PDF appears "), ("side", "other_failure", "Vertical or "), ("thin", "picture_heavy", "Most PDF pag")]
