"""From texts to the document model: paragraphs, words, totals, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill import schemas as S
from leafmill.functions import text as T


def paragraph_array(text: str | Column) -> Column:
    """Normalised non-blank lines of a text, in order; a pure expression, so paragraphs need no shuffle."""
    return T.normalized_lines(F.coalesce(T.col(text), F.lit("")))


def paragraphs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, paragraph_id from 1, text) of each non-blank line."""
    return documents.select(key, F.posexplode(paragraph_array(text)).alias("at", "text")).select(key, (F.col("at") + 1).alias("paragraph_id"), "text")


def words(paras: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, paragraph_id, word_index from 0, word); paragraphs without words vanish."""
    return paras.select(key, "paragraph_id", F.posexplode(T.tokenize("text")).alias("word_index", "word"))


def counted(paras: DataFrame) -> DataFrame:
    """Paragraphs with their number of words."""
    return paras.withColumn("words", T.count_words("text"))


def book_totals(documents: DataFrame) -> DataFrame:
    """Words, paragraphs and the largest paragraph of each document, by array expressions alone: no shuffle."""
    counts = F.transform(F.col("paras"), T.count_words)
    own = documents.select("doc_id", paragraph_array("text").alias("paras")).select("doc_id", counts.alias("counts"))
    total = F.aggregate("counts", F.lit(0), lambda a, x: a + x)
    return own.select("doc_id", F.size("counts").alias("paragraphs"), total.alias("words"), F.coalesce(F.array_max("counts"), F.lit(0)).alias("max_paragraph_words"))


def collapsed(words_: Column, n: Column, largest: Column) -> Column:
    return (words_ >= 1000) & ((n == 1) | (largest > 5000) | (largest / F.greatest(words_, F.lit(1)) > 0.9))


def chunk_paragraphs(paras: DataFrame, size: int = S.CHUNK_PARAGRAPHS, key: str = "doc_id") -> DataFrame:
    """Fixed groups of paragraphs in order: (key, chunk_index, paragraphs)."""
    at = F.floor((F.col("paragraph_id") - 1) / size).cast("int").alias("chunk_index")
    return paras.groupBy(key, at).agg(F.array_sort(F.collect_list(F.struct(F.col("paragraph_id").alias("id"), "text"))).alias("paragraphs"))


def chapters_every(paras: DataFrame, step: int = 3) -> DataFrame:
    """A chapter table over paragraphs: every ``step``-th starts one, titled by its first words."""
    starts = paras.where((F.col("paragraph_id") - 1) % step == 0)
    title = F.substring(F.col("text"), 1, 40)
    return starts.select("doc_id", F.floor((F.col("paragraph_id") - 1) / step).cast("int").alias("chapter_index"), title.alias("title"), F.col("paragraph_id").alias("start_paragraph_id"), T.nav_kind(title).alias("kind"))


def dedup_chapters(chapters: DataFrame, counts: DataFrame, key: str = "book_id") -> DataFrame:
    """Starts clamped to the book, bad titles dropped, the first of each (title, start) kept, in order of start and precedence.

    ``chapters``: key, pos, title, start_paragraph_id; ``counts``: key, paragraphs.
    """
    t = T.normalize_text("title")
    at = chapters.join(counts, key).select(key, "pos", t.alias("title"), F.greatest(F.lit(1), F.least(F.greatest(F.col("paragraphs"), F.lit(1)), F.col("start_paragraph_id"))).alias("start_paragraph_id")).where(F.length("title").between(1, 240))
    first = at.withColumn("n", F.row_number().over(Window.partitionBy(key, F.lower("title"), "start_paragraph_id").orderBy("pos"))).where("n = 1").withColumn("kind", T.nav_kind("title"))
    order = Window.partitionBy(key).orderBy("start_paragraph_id", T.nav_precedence(F.col("kind")), "pos")
    return first.select(key, (F.row_number().over(order) - 1).alias("chapter_index"), "title", "start_paragraph_id", "kind", T.nav_level(F.col("kind")).alias("level"))


def collapsed_starts(chapters: DataFrame, key: str = "book_id") -> DataFrame:
    """Whether a book of four chapters or more has distinct starts for less than 0.4 of them."""
    n, d = F.count("*"), F.count_distinct("start_paragraph_id")
    return chapters.groupBy(key).agg(n.alias("chapters"), d.alias("distinct_starts"), ((n >= 4) & (d / n < 0.4)).alias("collapsed"))
