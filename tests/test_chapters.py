"""Kinds of titles, scored matches of contents, likeness by telling tokens: fixed cases and brute force."""

import random

from pyspark.sql import functions as F

from leafmill.operators import chapters as C
from leafmill.operators import geometry as G

#: A full stop, a digit, a letter and the end behind each word that tells a kind.
KINDS = {
    "vol.2": "volume", "vol. 2": "other", "vol.": "other", "vol": "other", "Volume": "volume", "volume.": "volume", "Volume 2": "volume", "volumes": "other", "volume2": "other",
    "Letter": "letter", "letter.": "letter", "letter4": "other", "letters": "other", "LETTER IV": "letter",
    "Chapter": "chapter", "Chapter.": "chapter", "chapter 1": "chapter", "chapter1": "other", "Chapters": "other",
    "Book.": "book", "book9": "other", "Part": "part", "Part-two": "part", "parts": "other", "part_2": "other",
    "Act": "act", "act.": "act", "act5": "other", "action": "other", "Second  Act": "act", "sixth act": "other", "First act.": "act",
    "Scene": "scene", "Scene 1": "scene", "scenery": "other", "Dramatis Personæ": "dramatis", "Epilogue.": "play-section", "Epilogue": "front", "induction 2": "play-section", "Prologue of Two": "play-section",
    "IV. The Road": "numbered", "12: Home": "numbered", "12 Home": "numbered", "12": "other", "iv": "other", "x-ray": "numbered", "4th of May": "other",
    "[ A ]": "front", "Preface to all": "front", "Prefaces": "other", "The End": "back", "Full License": "back", "Some Short Stories": "front", "A Great Voyage": "front", "GREAT VOYAGE": "other", "": "other",
}


def test_kinds(spark):
    got = {r["t"]: r["k"] for r in spark.createDataFrame([(t,) for t in KINDS], "t string").select("t", C.chapter_kind(F.col("t"), F.lit("A Great Voyage")).alias("k")).collect()}
    assert got == KINDS


def test_title_match_and_clean_up(spark):
    rows = [("the sea", "the sea", True), ("the sea is", "the sea", True), ("the sea.", "the sea", True), ("the sea,", "the sea", True), ("o the seaside", "the sea", True), ("far away from all of the sea", "the sea", False), ("3", "3. home", True), ("chapter 3", "3. home", True), ("home", "3. home", True), ("", "x", False)]
    got = spark.createDataFrame(rows, "p string, t string, want boolean").where(C.title_match(F.col("p"), F.col("t")) != F.col("want")).collect()
    assert got == []


def brute_matches(toc, paras):
    out = {}
    for book, ord_, title, file, kind in toc:
        t = title.lower()
        number, _, rest = t.partition(".")
        best = None
        for b, pid, text, pfile, spine, total in paras:
            p = " ".join(text.lower().split())
            by_number = number.isdigit() and rest.strip() and p in (number, "chapter " + number, rest.strip())
            if b != book or not p or not t or not (p == t or p.startswith(t + " ") or p in (t + ".", t + ",") or (len(p) < len(t) + 15 and t in p) or by_number):
                continue
            s = 90 * (file == pfile) + 55 * (p == t) + 25 * p.startswith(t + " ") + 10 * (len(text) <= len(title) + 24) - 30 * (pid <= max(20, int(total * 0.05))) + {"chapter": 20, "letter": 20, "numbered": 20, "other": 10, "front": -60, "back": -60}.get(kind, 0) + 10 * (file == pfile and spine > 0)
            if best is None or s > best[0]:
                best = (s, pid)
        if best:
            out[book, ord_] = best
    return out


def test_scored_matches(spark):
    rng = random.Random(2)
    words = ["the", "sea", "a", "3", "3.", "seaside", "chapter", "home", "home,", "x" * 60]
    paras = [(b, i + 1, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5, 40]))), i % 3, i % 3, 120) for b in (1, 2) for i in range(120)]
    toc = [(b, i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), i % 3, rng.choice(["chapter", "other", "front", "part", "numbered"])) for b in (1, 2) for i in range(60)]
    toc += [(1, 99, "3. the sea", 1, "numbered"), (1, 98, "", 1, "other"), (1, 97, "y" * 300, 1, "other"), (3, 1, "home", 1, "other")]
    got = G.toc_scored_match(spark.createDataFrame(toc, "book_id int, ord int, title string, file int, kind string"), spark.createDataFrame(paras, "book_id int, paragraph_id int, text string, file int, spine int, total int"))
    assert {(r["book_id"], r["ord"]): (r["score"], r["paragraph_id"]) for r in got.collect()} == brute_matches(toc, paras)


def test_likeness(spark):
    rng = random.Random(6)
    words = [f"w{i}" * (1 + i % 3) for i in range(14)]
    rows = [(i, sorted(rng.sample(words, rng.randint(1, 12)))) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, t array<string>").withColumn("g", F.lit(1))
    got = {(r["i"], r["j"]) for r in G.alike(df.select("g", "i", F.col("t").alias("a")), df.select("g", F.col("i").alias("j"), F.col("t").alias("b")), ["g"], "a", "b").collect()}
    assert got == {(i, j) for i, x in rows for j, y in rows if len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.8}


def test_title_keys(spark):
    rows = [("Chapter  The ﬁrst Day", "the first day"), ("SECTION １２: Über—alles", "12 über alles"), ("chapters of it", "chapters of it"), ("...", ""), (None, None), ("日本 II", "日本 ii")]
    got = spark.createDataFrame(rows, "t string, want string").withColumn("got", C.title_key("t")).where("NOT (got <=> want)").collect()
    assert got == []
