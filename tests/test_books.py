"""Whole-book validation, speech from a position, furniture, corpus order: fixed cases."""

from pyspark.sql import functions as F

from leafmill.operators import evaluate as E
from leafmill.operators import geometry as G
from leafmill.operators import speech
from leafmill.operators import validate as V

CHAPTERS = "doc_id string, chapter_index int, title string, start_paragraph_id int"
IMAGES = "doc_id string, image_index int, after_paragraph_id int, src string"


def test_whole_books(spark):
    prose = " ".join(f"word{i} goes" for i in range(40))
    good = [("good", i, i + 1, prose, "rule" if i == 3 else None) for i in range(6)]
    bad = [("bad", 0, 1, prose, "rule"), ("bad", 5, 3, "", None), ("bad", 6, 3, "* * *", None)] + [("bad", 10 + i, 4 + i, prose, "rule") for i in range(30)]
    many = [("many", i, i + 1, "", None) for i in range(50_001)]
    paragraphs = spark.createDataFrame(good + bad + many, "doc_id string, place int, id int, text string, scene string")
    books = spark.createDataFrame([(b, "epub", 0, "c.png", 5.0, True) for b in ("good", "bad", "many")] + [("none", "pdf", 4, None, None, False)], "doc_id string, format string, declared int, cover_src string, total_ms double, totals_ok boolean")
    chapters = spark.createDataFrame([("good", 0, "One", 1), ("bad", 0, "...", 99), ("many", 0, "x", 1)], CHAPTERS)
    images = spark.createDataFrame([("bad", 0, 99, "blob:x")], IMAGES)
    given = spark.createDataFrame([("good", -1, "Other", "warning", "other", "said before")] * 2, "doc_id string, pos int, bucket string, severity string, code string, message string")
    got = {}
    for r in V.validate_books(paragraphs, chapters, images, books, given).orderBy("pos").collect():
        got.setdefault(r["doc_id"], []).append((r["code"], r["message"]))
    assert [m for _, m in got["good"]] == ["said before"]
    assert [c for c, _ in got["bad"]] == ["ornament_junk", "empty_paragraphs", "bad_paragraph_ids", "bad_paragraph_ids", "scene_break_density", "weak_chapters", "images_invalid"]
    assert got["bad"][2][1] == "Paragraph index 1 has id 3; expected 2." and got["bad"][3][1].startswith("1 scene breaks") and got["bad"][4][1].endswith("31 breaks across 33 paragraphs.")
    assert [c for c, _ in got["many"]] == ["too_many_paragraphs"]
    assert [c for c, _ in got["none"]] == ["unusable_text", "weak_chapters", "images_undeclared", "cover_missing", "totals_mismatch", "timing_invalid"]


def test_speech_from_a_position(spark):
    paras = spark.createDataFrame([("b", 1, "never said", 100), ("b", 2, "one two three four", 200), ("b", 3, "... -- five", 300), ("b", 4, "six " * 3 + "x" * 30, 400)], "doc_id string, paragraph_id int, text string, pause_ms int")
    at = lambda p, w: spark.createDataFrame([("b", p, w)], "doc_id string, paragraph_id int, word_index int")
    plan = lambda p, w: [(r["paragraph_id"], r["chunk"], r["text"], r["start_word"], r["pause_before_ms"], [tuple(x) for x in r["ranges"]]) for r in speech.spoken_plan(paras, at(p, w), 12).orderBy("paragraph_id", "chunk").collect()]
    got = plan(2, 1)
    assert got[0] == (2, 0, "two three", 1, 0, [(0, 3, 1), (4, 9, 2)]) and got[1] == (2, 1, "four", 3, 0, [(0, 4, 3)])
    assert got[2][0] == 3 and got[2][4] == 300 and [g[4] for g in got[3:]] == [400, 0]
    assert got[-1][2] == "x" * 30
    assert plan(2, 99)[0][0] == 3 and plan(2, 99)[0][4] == 300  # nothing is left of the paragraph where speech starts
    assert plan(77, 1)[0][2:4] == ("said", 1)  # an unknown paragraph counts as the first


def test_pages_without_lines_count(spark):
    lines = spark.createDataFrame([("b", p, "Running Head", 5.0, 100.0) for p in (1, 2, 3)] + [("b", p, f"prose {p}", 50.0, 100.0) for p in (1, 2, 3)], "book_id string, page int, text string, baseline double, height double")
    assert G.without_furniture(lines).count() == 3
    pages = spark.createDataFrame([("b", p) for p in range(1, 21)], "book_id string, page int")
    assert G.without_furniture(lines, every_page=pages).count() == 6


def test_corpus_order(spark):
    items = [("a", "1", "epub", "harvest-variety"), ("b", "2", "epub", "golden-reference"), ("c", "9", "epub", "harvest-variety"), ("d", "4", "epub", "curated-popular"), ("e", "5", "pdf", None)]
    got = E.corpus_selection(spark.createDataFrame(items, "id string, remote_id string, format string, reason string"), 3, "9").orderBy("format", "rank").collect()
    assert [(r["format"], r["id"]) for r in got] == [("epub", "c"), ("epub", "b"), ("epub", "d"), ("pdf", "e")]


def test_top_failures(spark):
    rows = [(i, b, "failure") for b, n in ((0, 2), (1, 5), (4, 2), (7, 1), (6, 1)) for i in range(n)] + [(9, 3, "warning")]
    d = spark.createDataFrame([(i, V.S.BUCKETS[b], s) for i, b, s in rows], "doc_id int, bucket string, severity string")
    got = [(r["rank"], r["bucket"], r["books"]) for r in E.top_failures(d).orderBy("rank").collect()]
    assert got == [(1, V.S.BUCKETS[1], 5), (2, V.S.BUCKETS[0], 2), (3, V.S.BUCKETS[4], 2)] and E.top_failures(d.where(F.lit(False))).count() == 0


def test_trees_and_batches(spark):
    from leafmill.operators import layout as L
    from leafmill.operators import repository as R

    nodes = spark.createDataFrame([("a", "p", "book", "alpha"), ("B", "p", "book", "Beta"), ("z", "p", "folder", "zeta"), ("c", "p", "book", "Alpha 2"), ("r", None, "folder", "root")], "id string, parent_id string, kind string, name string")
    assert [r["id"] for r in L.sorted_tree(nodes).where("parent_id = 'p'").orderBy("nth").collect()] == ["z", "a", "c", "B"]
    imports = spark.createDataFrame([(1, "completed", 600), (1, "failed", 600), (1, "queued", 600), (2, "queued", 600), (3, "canceled", 600), (4, "completed", 0), (4, "queued", 0)], "batch_id int, status string, elapsed_ms int")
    got = {r["batch_id"]: (r["total"], r["finished"], r["active"], r["remaining_ms"]) for r in R.batch_progress(imports).collect()}
    assert got == {1: (3, 2, 1, 300.0), 2: (1, 0, 1, None), 3: (1, 1, 0, None), 4: (2, 1, 1, None)}
