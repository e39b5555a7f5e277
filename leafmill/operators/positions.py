"""Positions {paragraph, word}: prefix sums, progress, chapter lookup and bounds, display rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T


def by_paragraph(key: str = "doc_id") -> Window:
    return Window.partitionBy(key).orderBy("paragraph_id")


def word_prefix(counted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds words_before (words of the paragraphs before) and total_words; one window over a key."""
    before = F.sum("words").over(by_paragraph(key).rowsBetween(Window.unboundedPreceding, -1))
    return counted.withColumns({"words_before": F.coalesce(before, F.lit(0)), "total_words": F.sum("words").over(Window.partitionBy(key))})


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up, from 0 to 100; 0 of nothing."""
    return F.when(whole > 0, F.greatest(F.lit(0), F.least(F.lit(100), T.js_round(part / whole * 100)))).otherwise(0)


def percent_complete(prefixed: DataFrame, word_index: Column) -> Column:
    inside = F.greatest(F.lit(0), F.least(F.col("words"), word_index))
    return percent(F.col("words_before") + inside, F.col("total_words"))


def chapter_of_paragraph(paras: DataFrame, chapters: DataFrame, key: str = "doc_id") -> DataFrame:
    """As-of: the last chapter that starts at or before a paragraph, the first chapter where none does.

    Chapters and paragraphs are united and filled forward, one shuffle by key and no range join; a chapter row
    sorts before the paragraph of the same id.
    """
    marks = chapters.select(key, F.col("start_paragraph_id").alias("paragraph_id"), F.col("chapter_index"), F.lit(0).alias("kind_rank"))
    rows = paras.select(key, "paragraph_id", F.lit(None).cast("int").alias("chapter_index"), F.lit(1).alias("kind_rank"))
    w = Window.partitionBy(key).orderBy("paragraph_id", "kind_rank", "chapter_index").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min("chapter_index").over(Window.partitionBy(key))
    filled = marks.unionByName(rows).withColumn("chapter", F.coalesce(F.last("chapter_index", True).over(w), first))
    return filled.where("kind_rank = 1").select(key, "paragraph_id", F.col("chapter").alias("chapter_index"))


def deepest_per_start(chapters: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of the entries of one start the one of highest precedence, the last of equals."""
    rank = F.struct(T.nav_precedence(F.col("kind")), "chapter_index")
    best = F.max_by(F.struct("chapter_index", "title", "kind"), rank)
    return chapters.groupBy(key, "start_paragraph_id").agg(best.alias("b")).select(key, "start_paragraph_id", "b.*")


def chapter_bounds(chapters: DataFrame, prefixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Right-open intervals of paragraphs and their words: (key, chapter_index, start, end_exclusive, words_before, words).

    One chapter that starts at no paragraph makes all chapters of its book unusable: it has no intervals.
    """
    starts = deepest_per_start(chapters, key)
    last = prefixed.groupBy(key).agg(F.max("paragraph_id").alias("n"), F.max("total_words").alias("total_words"))
    at = starts.join(prefixed.select(key, F.col("paragraph_id").alias("start_paragraph_id"), "words_before"), [key, "start_paragraph_id"], "left").join(last, key)
    order = Window.partitionBy(key).orderBy("start_paragraph_id")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = at.withColumns({"next_start": F.lead("start_paragraph_id").over(order), "next_words": F.lead("words_before").over(order), "lost": F.count_if(F.col("words_before").isNull()).over(every)})
    return at.where("lost = 0").select(key, "chapter_index", F.col("start_paragraph_id").alias("start"), F.coalesce("next_start", F.col("n") + 1).alias("end_exclusive"), "words_before", (F.coalesce("next_words", "total_words") - F.col("words_before")).alias("words"))


def chapter_percent(prefixed: DataFrame, bounds: DataFrame, word_index: Column, key: str = "doc_id") -> DataFrame:
    """Progress inside the chapter; inside the book where the position lies before the first chapter."""
    marks = bounds.select(key, F.col("start").alias("paragraph_id"), F.struct(F.col("words_before").alias("begin"), F.col("words").alias("size")).alias("chapter"), F.lit(0).alias("kind_rank"))
    rows = prefixed.select(key, "paragraph_id", "words", "words_before", "total_words", F.lit(1).alias("kind_rank"))
    w = Window.partitionBy(key).orderBy("paragraph_id", "kind_rank").rowsBetween(Window.unboundedPreceding, 0)
    filled = marks.unionByName(rows, allowMissingColumns=True).withColumn("c", F.last("chapter", True).over(w)).where("kind_rank = 1")
    inside = F.col("words_before") + F.greatest(F.lit(0), F.least(F.col("words"), word_index))
    of_book = percent(inside, F.col("total_words"))
    return filled.select(key, "paragraph_id", F.when(F.col("c").isNull(), of_book).otherwise(percent(inside - F.col("c.begin"), F.col("c.size"))).alias("chapter_percent"))


def next_positions(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """The position after each word; paragraphs without words are skipped because they have no rows."""
    w = Window.partitionBy(key).orderBy("paragraph_id", "word_index")
    ahead = F.lead(F.struct("paragraph_id", "word_index", "word")).over(w)
    return words.withColumn("n", ahead).select(key, "paragraph_id", "word_index", "word", F.col("n.paragraph_id").alias("next_paragraph_id"), F.col("n.word_index").alias("next_word_index"), F.col("n.word").alias("next_word"))


def display_rows(paras: DataFrame, images: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reading order: a scene break before its paragraph, images after theirs; anchor 0 stands first. Images whose anchor does not exist vanish.

    ``paras``: key, paragraph_id, scene_break_before; ``images``: key, image_index, after_paragraph_id.
    """
    none = F.lit(None).cast("int")
    texts = paras.select(key, "paragraph_id", F.lit(1).alias("rank"), none.alias("image_index"), F.lit("paragraph").alias("kind"))
    breaks = paras.where("scene_break_before IS NOT NULL").select(key, "paragraph_id", F.lit(0).alias("rank"), none.alias("image_index"), F.lit("scene-break").alias("kind"))
    known = paras.select(key, "paragraph_id").unionByName(paras.select(key, F.lit(0).alias("paragraph_id")).distinct())
    pictures = images.withColumnRenamed("after_paragraph_id", "paragraph_id").join(known, [key, "paragraph_id"], "left_semi").select(key, "paragraph_id", F.lit(2).alias("rank"), F.col("image_index").cast("int").alias("image_index"), F.lit("image").alias("kind"))
    order = Window.partitionBy(key).orderBy("paragraph_id", "rank", "image_index")
    return texts.unionByName(breaks).unionByName(pictures).select(key, (F.row_number().over(order) - 1).alias("row_index"), "kind", "paragraph_id", "image_index")


def duplicate_headings(paras: DataFrame, chapters: DataFrame, key: str = "doc_id") -> DataFrame:
    """Paragraphs that repeat the title of the first chapter or part starting there."""
    first = chapters.groupBy(key, F.col("start_paragraph_id").alias("paragraph_id")).agg(F.min_by(F.struct("title", "kind"), "chapter_index").alias("c"))
    same = T.comparable_heading("text") == T.comparable_heading(F.col("c.title"))
    return paras.join(first, [key, "paragraph_id"]).select(key, "paragraph_id", (F.col("c.kind").isin("chapter", "part") & same).alias("duplicate"))
