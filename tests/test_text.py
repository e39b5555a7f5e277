"""Text functions on small fixed inputs."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as T


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tokenize(spark):
    got = values(spark, T.tokenize, ["alpha   beta\tgamma\ndelta", "\"hello\" 'world' \"\"quoted\"\" ''test''", "can't end-to-end mother-in-law", ' ""   \'\'   "ok" ', "a b﻿c", "", "\n"])
    assert got == [["alpha", "beta", "gamma", "delta"], ["hello", "world", "quoted", "test"], ["can't", "end-to-end", "mother-in-law"], ["ok"], ["a", "b", "c"], [], []]


@pytest.mark.parametrize(
    "title,kind",
    [("Contents", "frontmatter"), (" Title  Page", "frontmatter"), ("Index of names", "backmatter"), ("Part One", "part"), ("Bookkeeping", "chapter"), ("Scene 3", "scene"), ("Appendix A", "section"), ("The Storm", "chapter")],
)
def test_nav_kind(spark, title, kind):
    assert values(spark, T.nav_kind, [title]) == [kind]


def test_ordinals(spark):
    assert values(spark, T.ordinal_parse, ["7", "Twelve", "iv", "XLII", "mcmxc", "x1", "", None]) == [7, 12, 4, 42, 1990, None, None, None]


def test_paths(spark):
    assert values(spark, T.path_normalize, ["a/./b/../c", "../../x", "/a//b/", ""]) == ["a/c", "x", "a/b", ""]
    assert values(spark, T.path_extname, ["a/b.TXT", "b", ".hidden", "x.tar.gz"]) == [".txt", "", "", ".gz"]
    assert values(spark, T.path_dirname, ["a/b/c", "c"]) == ["a/b", ""]


def test_uri_and_titles(spark):
    assert values(spark, T.safe_uri_decode, ["a%20b+c", "100%", "%zz"]) == ["a b+c", "100%", "%zz"]
    assert values(spark, T.filename_title, ["x/My_great-Book.epub", "__.pdf"]) == ["My great Book", "Untitled"]


def test_scene_ornament(spark):
    assert values(spark, T.scene_ornament, ["* * *", "***", "⁂", "**", "* a *", "• — •", "◆ ◆ ◆"]) == [True, True, True, False, False, False, True]


def test_wrapped_lines(spark):
    df = spark.createDataFrame([(["a hyphen-", "ated word", "next", "line-", "Up"],)], "x array<string>")
    assert df.select(T.join_wrapped("x")).first()[0] == "a hyphenated word next line- Up"


def test_sentences(spark):
    assert values(spark, T.sentence_split, ["One. Two? “Three!” Four.five. six"]) == [["One.", "Two?", "“Three!”", "Four.five. six"]]


def test_fnv(spark):
    assert values(spark, T.fnv1a, ["", "a", "foobar"]) == [2166136261, 0xE40C292C, 0xBF9CF968]


def test_srcset_and_media(spark):
    assert values(spark, T.srcset_best, ["a.png 1x, b.png 3x, c.png 2x", "one.png", "x 100w, y 100w"]) == ["b.png", "one.png", "x"]
    assert values(spark, lambda c: T.media_type(c), ["a.JPG", "b.svg", "c.txt"]) == ["image/jpeg", "image/svg+xml", None]


def test_dedup_and_authors(spark):
    df = spark.createDataFrame([(["A", " a ", "", "b", "B"],)], "x array<string>")
    assert df.select(T.dedup_strings("x")).first()[0] == ["A", "b"]
    assert values(spark, T.split_authors, ["Ann One; Bob Two and Cy\nDi"]) == [["Ann One", "Bob Two", "Cy", "Di"]]


def test_simple_words(spark):
    assert values(spark, T.simple_word_pattern, ["\"Reserved.\"", "a+b", "   ", "--"]) == [r"\bReserved\b", r"\ba\+b\b", "", r"\b--\b"]
