"""Steps whose work once grew faster than their input, or was done many times over."""

import time

from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import assembly as A
from leafmill.operators import chapters as C
from leafmill.operators import geometry as G
from leafmill.operators import model as M
from leafmill.operators import pdf_text as D
from leafmill.operators import recovery as R


def stages(spark) -> int:
    """How many stages the session has planned so far."""
    store = spark.sparkContext._jsc.sc().statusStore()
    return store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).size()


def test_lines_are_normalised_as_texts(spark):
    texts = ["a­ b\t\tc \n\n 　\n  d  e\r\n'' \"x\" ''", "", None, " \n", "plain words", "a  b\n\n\nc"]
    row = spark.createDataFrame([(t,) for t in texts], "text string")
    got = row.select(M.paragraph_array("text"), T.normalize_text("text"), T.tokenize("text")).collect()
    assert [r[0] for r in got] == [["a b c", "d e", "'' \"x\" ''"], [], [], [], ["plain words"], ["a b", "c"]]
    assert got[0][1] == "a b c d e '' \"x\" ''" and got[0][2] == ["a­", "b", "c", "d", "e", "x"]


def test_titles_that_hold_each_other(spark):
    pairs = [("the sea, the", "sea"), ("the  sea!", "the sea"), ("the - sea", "the sea"), ("sea the", "the sea"), ("...", "the sea"), ("x the-sea y", "the sea"), ("sea", "the sea")]
    got = spark.createDataFrame(pairs, "a string, b string").select(C.within(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [True, True, True, False, True, True, True]


def test_joined_lines_are_linear(spark):
    lines = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i: F.when(i % 3 == 0, "").when(i % 2 == 0, "word-").otherwise("and more")).alias("x"))
    began = time.perf_counter()
    text = lines.select(D.joined(F.col("x")).alias("t")).first()["t"]
    assert time.perf_counter() - began < 20
    assert text.startswith("and more wordwordand more and more wordwordand more and more")


def test_copies_of_headings_make_no_pairs(spark):
    # 3,000 copies of a heading and of an entry: nine million pairs, if each were held against each
    copies = spark.range(1, 3001).select(F.lit(1).alias("book_id"), F.col("id").alias("n"), F.lit("the long way home again my friend").alias("title"))
    entries = copies.select("book_id", F.col("n").alias("ord"), F.concat("title", F.lit(" now")).alias("title"))
    began = time.perf_counter()
    got = G.outline_match(entries, copies.select("book_id", F.col("n").alias("paragraph_id"), "title")).groupBy("paragraph_id").count().collect()
    assert [(r["paragraph_id"], r["count"]) for r in got] == [(1, 3000)]
    assert time.perf_counter() - began < 25


def test_image_anchors_broadcast_no_table(spark):
    images = spark.createDataFrame([(1, 0, 7, 50.0, 30.0, 500.0)], "book_id long, page long, image_id long, x double, y double, width double")
    lines = spark.createDataFrame([(1, 0, 3, 0, 10.0, 0.0, 90.0)], "book_id long, page long, paragraph_id long, col int, baseline double, x_min double, x_max double")
    df = D.image_anchors(images, lines)
    assert df.first()["after_paragraph_id"] == 3
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_recovery_makes_its_parts_once(spark):
    p = spark.createDataFrame([(1, i, f"Chapter {i}. Of the things that came {'x' * i}", "a") for i in range(1, 12)], "book_id long, paragraph_id int, text string, file string")
    books = spark.createDataFrame([(1, "The Sea")], "book_id long, title string")
    before = stages(spark)
    chapters = books.select("book_id", F.lit(1).alias("pos"), F.lit(1).alias("start"), F.lit("An essay").alias("title"))
    entries = p.select("book_id", F.col("paragraph_id").alias("ord"), F.col("text").alias("title"), "file", F.lit("").alias("anchor"), F.lit(1).alias("depth"), F.lit("unknown").alias("category"))
    assert R.recover_collapsed(chapters, entries, p, books).count() > 1
    assert stages(spark) - before < 200


def test_books_are_built_from_texts_read_once(spark):
    places = spark.createDataFrame([(1, 2, " a  b "), (1, 4, ""), (1, 6, "c")], "book long, place long, text string")
    point = places.select("book", F.col("place").alias("ord"), "place")
    made = A.build_books(
        places.select("book").distinct(), places.withColumn("scene", F.lit("rule")), point.where("place = 6").withColumn("title", F.lit("t")), point.withColumns({"alt": F.lit("i"), "src": F.lit("s")}), point.select("book", F.lit("p").alias("path"), F.lit("f").alias("fragment"), "place")
    )
    assert sorted((r["id"], r["text"], r["scene"]) for r in made.paragraphs.collect()) == [(1, "a b", None), (2, "c", None)]
    assert made.totals.first().asDict() == {"book": 1, "paragraphs": 2, "words": 3, "chapters": 1, "images": 3, "scene_breaks": 0}
    # the text is normalised before the cut, so no plan behind it looks for white space
    assert "regexp_replace" not in made.paragraphs._jdf.queryExecution().optimizedPlan().toString()


def test_even_texts_are_not_walked_by_the_pattern(spark):
    # every white space of the class by itself and doubled, inside and at the ends, beside wide characters and without
    spaces = [" ", "\t", "\x0b", "\x0c", "\r", " ", " ", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　", "﻿"]
    texts = [f for s in spaces for f in (f"a{s}b", f"é{s}b\n{s}\nc{s}", f"{s}a{s}{s}b", f"a {s}b­ c")]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", M.paragraph_array("text"), F.filter(F.transform(F.split("text", "\n"), T.normalize_text), lambda x: x != "")).collect()
    assert all(r[1] == r[2] for r in rows), [r for r in rows if r[1] != r[2]][:3]
    big = spark.range(4000).select(F.repeat(F.concat(F.repeat(F.lit("plain words of a text "), 40), F.lit("wörd"), F.col("id").cast("string"), F.lit("\n")), 30).alias("text")).persist()
    big.count()

    def seconds(c) -> float:
        began = time.perf_counter()
        big.agg(F.sum(F.length(F.to_json(F.slice(c, 1, 1))))).first()
        return time.perf_counter() - began

    walked = F.filter(F.transform(F.split(F.regexp_replace(F.replace("text", F.lit("­"), F.lit("")), T._UNEVEN_IN_LINE, " "), "\n"), F.trim), lambda x: x != "")
    assert min(seconds(T.normalized_lines("text")) for _ in range(2)) < 0.9 * min(seconds(walked) for _ in range(2))
    big.unpersist()


def test_gap_clusters_without_python(spark):
    gaps = spark.createDataFrame([(1, 0, float(g)) for g in (9, 1, 1.5, 5, 1.2, 5.4)] + [(2, 3, 7.0)], "book_id long, page long, gap double")
    df = G.gap_clusters(gaps, 1)
    assert sorted(map(tuple, df.collect())) == [(1, 0, 0, 3, 1.2), (1, 0, 1, 2, 5.2), (1, 0, 2, 1, 9.0), (2, 3, 0, 1, 7.0)]
    assert "InArrow" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_schedule_shuffles_paragraphs_not_words(spark):
    from leafmill.operators import schedule

    paras = spark.range(1, 5).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("paragraph_id"), F.split(F.rtrim(F.repeat(F.lit("word, "), 5000)), " ").alias("tokens"))
    of = paras.select("doc_id", "paragraph_id", F.lit(0).alias("chapter_index"), F.lit("chapter").alias("kind"), F.lit(False).alias("scene"))

    def written() -> int:
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    rows = schedule.paragraph_schedule(paras, of).agg(F.count("*").alias("n"), F.max("word_seq").alias("last"), F.sum("delay_ms").alias("all"), F.max("at_ms").alias("at")).first()
    assert (rows["n"], rows["last"]) == (20_000, 19_999) and rows["all"] == rows["at"]
    assert written() - before < 100


def shuffled_bytes(spark) -> int:
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def noise(spark, n: int):
    """``n`` rows whose texts of 6,400 characters do not compress well."""
    return spark.range(1, n + 1).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.sha2(F.concat_ws(" ", "id", i), 256)), "").alias("text"))


def test_furniture_moves_no_texts(spark):
    lines = noise(spark, 1000).select(F.lit("b").alias("book_id"), F.floor(F.col("id") / 10).cast("int").alias("page"), F.col("id").alias("line_order"), "text", (F.col("id") % 10 * 10).cast("double").alias("baseline"), F.lit(100.0).alias("height"))
    before = shuffled_bytes(spark)
    assert sorted(r["line_order"] for r in G.without_furniture(lines).select("line_order").collect()) == list(range(1, 1001))
    whole, before = shuffled_bytes(spark) - before, shuffled_bytes(spark)
    kept = G.drop_furniture(G.furniture_marks(lines).drop("text"))
    assert kept.count() == 1000 and "text" not in kept.columns
    assert shuffled_bytes(spark) - before < 300_000 < whole


def test_long_edge_lines_have_signatures(spark):
    # a line of more than 180 characters counts for no signature, but goes where shorter ones make it recur; a footer of legal matter is no edge line of another page
    lines = [("b", p, f"page of the book {p}", 5.0) for p in range(1, 7)] + [("b", 7, f"page of the book {'7' * 200}", 5.0), ("b", 8, "8" * 200, 5.0), ("b", 8, "©", 90.0), ("b", 8, "gone", 95.0), ("b", 9, None, 5.0), ("b", 9, None, 50.0), ("b", 9, "x", None)]
    df = spark.createDataFrame(lines, "book_id string, page int, text string, baseline double").withColumn("height", F.lit(100.0))
    assert sorted(map(str, (tuple(r) for r in G.without_furniture(df).select("page", "baseline").collect()))) == sorted(map(str, [(8, 5.0), (9, 50.0), (9, None)]))


def test_chapter_rules_move_no_titles(spark):
    from leafmill.operators import validate as V

    chapters = noise(spark, 1000).select(F.lit("b").alias("doc_id"), F.col("id").alias("chapter_index"), F.col("text").alias("title"), F.col("id").alias("start_paragraph_id"))
    before = shuffled_bytes(spark)
    got = V.chapter_diagnostics(chapters, spark.createDataFrame([("b", 999), ("none", 3)], "doc_id string, paragraphs long"))
    assert sorted((r["doc_id"], r["message"][:44]) for r in got.collect()) == [("b", "Chapter list contains 1000 nonsense titles a"), ("none", "No chapter/navigation entry was extracted.")]
    assert shuffled_bytes(spark) - before < 300_000


def test_chapter_rules(spark):
    from leafmill.operators import validate as V

    # a first start below 1, one beyond the book, one that falls, one without; an unlisted book; four entries at one start
    rows = [("a", 1, "A", 0), ("a", 2, " . ", 9), ("a", 3, "B", 8), ("a", 4, None, None), ("gone", 1, "A", 1), *(("c", i, "T", 1) for i in range(4))]
    chapters = spark.createDataFrame(rows, "doc_id string, chapter_index int, title string, start_paragraph_id int")
    got = V.chapter_diagnostics(chapters, spark.createDataFrame([("a", 8), ("c", 5), ("d", None)], "doc_id string, paragraphs long"))
    assert sorted((r["doc_id"], r["message"]) for r in got.collect()) == [("a", "Chapter list contains 1 nonsense titles and 3 invalid starts."), ("c", "Chapter entries collapse to too few distinct paragraph starts."), ("d", "No chapter/navigation entry was extracted.")]


def test_titles_are_normalised_once(spark):
    texts = ["­", " \n ", "a" * 240, "a" * 241, f"\t{'a ' * 120}", f"{'a  ' * 120}b", " 9 ", "« »", None, "a ­ b" * 60]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.sane_title("t"), F.length(T.normalize_text("t")).between(1, 240) & T.normalize_text("t").rlike(r"[\p{L}\p{N}]"), T.with_normalized("t", lambda x: x), T.normalize_text("t")).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in rows) and [r[0] for r in rows][:4] == [False, False, True, False]


def test_printed_chapters_hold_one_sort(spark):
    books = spark.createDataFrame([("weak", "W", 100, 5, 9), ("weak", "W2", 10, 20, 9), ("twice", "T", 30, 1, 2), ("twice", "T", 30, 1, 2), (None, "N", 3, 1, 0), ("empty", "E", 0, 1, 0)], "book_id string, title string, paragraphs int, pages int, items int")
    # at start 7 two numbers; two distinct titles of three headings are too few to replace the outline of a typesetter
    outline = spark.createDataFrame([("weak", 1, "Cover Front", 1, False), ("twice", 1, "A", 1, True), ("twice", 2, None, None, True), (None, 1, "x", 1, True), ("gone", 1, "x", 1, True)], "book_id string, ord int, title string, start int, matched boolean")
    heads = spark.createDataFrame([("weak", t, s, 1.2, None) for t, s in (("One", 1), ("one!", 30), ("Two", 60), ("", 61))] + [("twice", "Chapter 1", 5, 1.0, True), ("gone", "Preface", 1, 1.0, True)], "book_id string, title string, start int, prominence double, strong boolean")
    chapters, said = D.choose_chapters(books, outline, heads)
    rows = lambda df, *names: sorted(map(str, (tuple(r) for r in df.select(*names).collect())))
    assert rows(chapters, "book_id", "title", "start") == sorted(map(str, [("weak", "Cover Front", 1)] * 2 + [("twice", "A", 1), ("twice", None, None)] * 2))
    assert rows(said.groupBy("book_id").count(), "book_id", "count") == sorted(map(str, [("weak", 3), (None, 1)]))
    # each sort, window buffer and aggregate of a stage holds memory of its own: one order serves all judgements
    plan = chapters._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange hashpartitioning"), plan.count("Sort ["), plan.count("Join"), plan.count("HashAggregate")) == (1, 1, 0, 0)


def test_spoken_ranges_of_a_long_paragraph_are_linear(spark):
    from leafmill.operators import speech

    words = [("wörd", "a", "longer")[i % 3] + str(i % 7) for i in range(200_000)]
    paras = spark.createDataFrame([(1, 1, " ".join(words), 5)], "doc_id long, paragraph_id int, text string, pause_ms int")
    starts = spark.createDataFrame([(1, 1, 3)], "doc_id long, paragraph_id int, word_index int")
    began = time.perf_counter()
    got = speech.spoken_plan(paras, starts, 300).orderBy("chunk").collect()
    assert time.perf_counter() - began < 30
    assert [r["start_word"] for r in got[:2]] == [3, 3 + got[0]["n_words"]] and sum(r["n_words"] for r in got) == 200_000 - 3
    assert " ".join(r["text"] for r in got) == " ".join(words[3:])
    assert all(r["text"][x["start"] : x["end"]] == words[x["word_index"]] for r in got[::50] for x in r["ranges"])
    # the next word had no place
    assert all(len(r["text"]) <= 300 < len(r["text"]) + 1 + len(after["text"].split()[0]) for r, after in zip(got, got[1:]))


def test_words_at_characters_are_looked_up_in_the_row(spark, tmp_path):
    from leafmill.operators import speech
    from leafmill.plans.catalog import QUERIES

    lines = ["'ab'  cd wörds and more 𝒳 x " + "w " * 200_000, "\"\"", "one", "tokens of ten, to thirty-seven characters, and then more than a hundred of them, so that all are found in here"]
    spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["char_to_word"](spark, str(tmp_path))
    began = time.perf_counter()
    got = sorted(map(tuple, df.collect()))
    assert time.perf_counter() - began < 20
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    p = M.paragraphs(spark.createDataFrame([(1, "\n".join(x[:300] for x in lines))], "doc_id long, text string"))
    asked = p.where(F.size(T.tokenize("text")) > 0).select("doc_id", "paragraph_id", F.explode(F.array(*[F.lit(x) for x in (0, 10, 37, 100)])).alias("offset"))
    assert got == sorted(map(tuple, speech.char_to_word(speech.speech_words(p, 1 << 30), asked, ["doc_id", "paragraph_id"]).collect()))
    assert spark.range(1).select(speech.word_at(F.lit("ab cd"), F.lit(-3)), speech.word_at(F.lit("ab cd"), F.lit(99))).first()[:] == (0, 1)
