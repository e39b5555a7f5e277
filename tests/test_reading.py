"""Positions, pacing, speech and rules on the small fixed books."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions import pacing as G
from leafmill.operators import model as M
from leafmill.operators import positions as P
from leafmill.operators import rules as R
from leafmill.operators import schedule, speech


@pytest.fixture(scope="module")
def book(spark):
    return spark.createDataFrame([(1, 1, "One two three"), (1, 2, ""), (1, 3, "Four five")], "doc_id int, paragraph_id int, text string")


@pytest.fixture(scope="module")
def chapters(spark):
    return spark.createDataFrame([(1, 0, "Ch 1", 1, "chapter"), (1, 1, "Ch 2", 3, "chapter")], "doc_id int, chapter_index int, title string, start_paragraph_id int, kind string")


def test_percent(book):
    pre = P.word_prefix(M.counted(book))
    at = lambda p, w: pre.where(F.col("paragraph_id") == p).select(P.percent_complete(pre, F.lit(w))).first()[0]
    assert [at(1, -10), at(1, 2), at(1, 999), at(3, 1)] == [0, 40, 60, 80]


def test_chapter_lookup(spark, chapters):
    paras = spark.createDataFrame([(1, 2), (1, 3), (1, 999), (1, 0)], "doc_id int, paragraph_id int")
    assert {r[1]: r[2] for r in P.chapter_of_paragraph(paras, chapters).collect()} == {2: 0, 3: 1, 999: 1, 0: 0}


def test_next_position_skips_empty(book):
    got = {(r["paragraph_id"], r["word_index"]): (r["next_paragraph_id"], r["next_word_index"]) for r in P.next_positions(M.words(book)).collect()}
    assert got[(1, 2)] == (3, 0) and got[(3, 1)] == (None, None)


def test_bounds_take_the_deepest_of_equal_starts(spark, book):
    ch = spark.createDataFrame([(1, 0, "Part I", 1, "part"), (1, 1, "One", 1, "chapter"), (1, 2, "Two", 3, "chapter")], "doc_id int, chapter_index int, title string, start_paragraph_id int, kind string")
    got = P.chapter_bounds(ch, P.word_prefix(M.counted(book))).orderBy("start").collect()
    assert [(r["chapter_index"], r["start"], r["end_exclusive"], r["words"]) for r in got] == [(1, 1, 3, 3), (2, 3, 4, 2)]


def breaks(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    return [r[0] for r in df.orderBy("i").select(G.sentence_break(F.col("a"), F.col("b"))).collect()]


def test_sentence_breaks(spark):
    assert breaks(spark, [("end.", "Next"), ("end.", "next"), ("Mr.", "Smith"), ("U.S.A.", "The"), ("3.14", "Pi"), ("what?", None), ("end.)", "(The"), ("end.", None)]) == [True, False, False, False, False, True, True, False]


def test_schedule(spark):
    paras = spark.createDataFrame([(1, 1, "Alpha sentence."), (1, 2, "Bridge paragraph here"), (1, 3, "New chapter starts now")], "doc_id int, paragraph_id int, text string")
    ch = spark.createDataFrame([(1, 0, "A", 1, "chapter"), (1, 1, "B", 3, "chapter")], "doc_id int, chapter_index int, title string, start_paragraph_id int, kind string")
    of = P.chapter_of_paragraph(paras, ch).join(ch.select("doc_id", "chapter_index", "kind"), ["doc_id", "chapter_index"]).withColumn("scene", F.lit(False))
    rows = schedule.word_schedule(M.words(paras), of, 300).orderBy("word_seq").collect()
    ramp = lambda i, n, s: int(60000 / (300 * (1 - s / 100) + (300 - 300 * (1 - s / 100)) * i / (n - 1)) + 0.5)
    start = [ramp(i, 25, 30) for i in range(9)]
    assert rows[0]["delay_ms"] == start[0]
    assert rows[2]["delay_ms"] == start[2] + 180  # after a paragraph
    assert rows[5]["delay_ms"] == max(start[5], ramp(0, 18, 15)) + 425  # after a chapter
    assert [r["at_ms"] for r in rows][-1] == sum(r["delay_ms"] for r in rows)


def test_tempo(spark):
    df = spark.createDataFrame([('{"commaBreakMs": 999, "chapterRampWords": 0}',), ("{}",), ("nonsense",)], "j string")
    got = [r[0] for r in df.select(G.tempo_sanitize(F.col("j"))).collect()]
    assert got[0]["commaBreakMs"] == 200 and got[0]["chapterRampWords"] == 1 and got[0]["sentenceBreakMs"] == 60 and got[1:] == [None, None]


def test_speech_chunks(spark):
    df = spark.createDataFrame([(1, 1, "aaa bbb ccc dddddddddddd e"), (1, 2, "")], "doc_id int, paragraph_id int, text string")
    got = speech.speech_chunks(df, 7).orderBy("chunk").collect()
    assert [r["text"] for r in got] == ["aaa bbb", "ccc", "dddddddddddd", "e"]
    ranges = speech.speech_words(df, 7).orderBy("word_index").collect()
    assert [(r["chunk"], r["start"], r["end"]) for r in ranges] == [(0, 0, 3), (0, 4, 7), (1, 0, 3), (2, 0, 12), (3, 0, 1)]


def token(spark, word, rules, preview=False):
    r = spark.createDataFrame([(word,)], "w string").select(R.apply_token(F.col("w"), R.active(rules, []), preview).alias("r")).first()["r"]
    return r["spoken"], r["matched"]


def test_rules(spark):
    simple = R.Rule("a", r"\bReserved\b", "Rereeere", "simple")
    assert token(spark, "Reserved.", [simple]) == ("Rereeere.", True)
    assert token(spark, "Reserved.", [simple], True) == ("Reserved.", False)
    assert token(spark, "xarqon", [R.Rule("r", "xarqon", "zar-kon"), R.Rule("s", "x.*", "no")]) == ("zar-kon", True)
    assert token(spark, "cafés", [R.Rule("r", r"\bcaf\b", "X", "simple")]) == ("Xés", True)
    df = spark.createDataFrame([("a b a",)], "t string")
    done = R.apply_chunk(F.col("t"), R.active([R.Rule("r", "a", "$&\\1")], []))
    assert tuple(df.select(done.alias("r")).select("r.*").first()) == ("$&\\1 b $&\\1", 2)


def test_three_hundred_rules(spark):
    """Rules that feed one another, over whole texts, against a plain loop."""
    import re

    rules = [R.Rule(f"r{i}", rf"w{i}\b" if i % 3 else f"(?:w{i})", f"w{i + 1}" if i % 7 else "<$1>") for i in range(300)]
    texts = [" ".join(f"w{(k * 37 + j) % 320}" for j in range(400)) for k in range(20)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    got = {r["t"]: (r["spoken"], r["matches"]) for r in df.select("t", R.apply_chunk(F.col("t"), R.active(rules, [])).alias("r")).select("t", "r.*").collect()}
    for t in texts:
        text, n = t, 0
        for r in rules if t is not None else ():
            text, k = re.subn(r.pattern, lambda m, r=r: r.replacement, text, flags=re.I | re.A)
            n += k
        assert got[t] == (text, n)


def test_rule_errors(spark):
    """The engine that runs a pattern judges it: a bad one is an error text and never a failed job."""
    assert R.rule_error(R.Rule("r", "(?P<x>a)", "x")).startswith("Invalid regex") and R.rule_error(R.Rule("r", "(?<x>a)", "x")) is None
    mixed = R.active([R.Rule("bad", "(?P<x>a)", "x"), R.Rule("good", "(?<x>a)", "y")], [])
    assert [r.id for r in mixed] == ["good"] and token(spark, "a", mixed) == ("y", True)
    assert R.rule_error(R.Rule("r", " ", "x")) == "Pattern is required"
    assert "too long" in R.rule_error(R.Rule("r", "a" * 201, "x")) and "too long" in R.rule_error(R.Rule("r", "a", "x" * 121))
    assert all("unsafe" in R.rule_error(R.Rule("r", p, "x")) for p in ("(a+)+", "(a|b)*", r"(a)\1"))
    assert R.rule_error(R.Rule("r", "[", "x")).startswith("Invalid regex") and R.rule_error(R.Rule("r", "a.c", "x")) is None


def test_preview(spark):
    books = spark.createDataFrame([(1, "xarqon hello\nxarqon world\n" + "word " * 26), (2, None), (3, "Xarqon\n" * 600)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in R.preview(books, [R.Rule("r", "xarqon", "z")]).collect()}
    row = lambda k: tuple(got[k][c] for c in ("total_matches", "affected_paragraphs", "unique_words", "high_impact"))
    assert row(1) == (2, 2, 1, True) and row(2) == (0, 0, 0, False) and row(3) == (600, 600, 1, True)
    assert [tuple(e) for e in got[1]["examples"]] == [("xarqon", "z")] * 2 and len(got[3]["examples"]) == 20 and abs(got[1]["percent"] - 2 / 30 * 100) < 1e-9


def test_unknown_chapter_start_falls_back_to_the_book(spark):
    book = spark.createDataFrame([(1, 1, "One two three"), (1, 2, "Four five")], "doc_id int, paragraph_id int, text string")
    chapters = spark.createDataFrame([(1, 0, "A", 1, "chapter"), (1, 1, "B", 7, "chapter")], "doc_id int, chapter_index int, title string, start_paragraph_id int, kind string")
    p = P.word_prefix(M.counted(book))
    bounds = P.chapter_bounds(chapters, p)
    assert bounds.isEmpty()
    assert [r["chapter_percent"] for r in P.chapter_percent(p, bounds, F.lit(1)).orderBy("paragraph_id").collect()] == [20, 80]
