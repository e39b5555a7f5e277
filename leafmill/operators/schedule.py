"""Playback schedules: when each word of a book is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import pacing as G


def running(values: Column, block: int = 256) -> Column:
    """Running sums of an array of longs; in blocks, so that no long array is copied for each element."""
    grow = lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    scan = lambda a: F.aggregate(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, 1), grow)
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  f of x, with x built once
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: scan(F.slice(v, b * block + 1, F.lit(block))))
    before = lambda parts: scan(F.transform(parts, lambda b: F.element_at(b, -1)))
    moved = lambda parts, sums: F.flatten(F.transform(parts, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: F.get(sums, i - 1) + x))))
    sums = lambda v: bound(blocks(v), lambda parts: bound(before(parts), lambda s: moved(parts, s)))
    return bound(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(sums(v)))


def word_schedule(words: DataFrame, chapter_of: DataFrame, wpm: int = 250, tempo: G.Tempo = G.Tempo(), key: str = "doc_id") -> DataFrame:
    """``paragraph_schedule`` of rows of words: key, paragraph_id, word_index, word."""
    listed = words.groupBy(key, "paragraph_id").agg(F.array_sort(F.collect_list(F.struct("word_index", "word"))).alias("w"))
    tokens = listed.select(key, "paragraph_id", F.transform("w", lambda x: x["word"]).alias("tokens"), F.transform("w", lambda x: x["word_index"]).alias("places"))
    return paragraph_schedule(tokens, chapter_of, wpm, tempo, key)


def paragraph_schedule(paras: DataFrame, chapter_of: DataFrame, wpm: int = 250, tempo: G.Tempo = G.Tempo(), key: str = "doc_id") -> DataFrame:
    """(key, paragraph_id, word_index, word_seq, delay_ms, at_ms): each word's delay before the next, and when it shows.

    ``paras``: key, paragraph_id, tokens (and places: their word_index, where they are not 0 and up); ``chapter_of``: key, paragraph_id, chapter_index, kind, scene. Counters are row numbers within the book and
    within the run of a chapter after the first. Pauses inside a paragraph come from its own words; what goes to the book's windows is a row a paragraph with these pauses and the words at its ends,
    so no word is ever a row of a shuffle or a sort.
    """
    no = F.lit(False)
    inside = lambda a, b: G.priority_pause(G.structural_pause(a, b, F.lit(True), F.lit(True), F.lit(None).cast("string"), no, tempo), a, tempo)
    pauses = F.transform(F.slice("tokens", F.lit(2), F.size("tokens")), lambda b, i: inside(F.get("tokens", i), b).cast("int"))
    places = [F.col("places")] if "places" in paras.columns else []
    own = paras.where(F.size("tokens") > 0).select(key, "paragraph_id", F.size("tokens").alias("n"), F.get("tokens", F.lit(0)).alias("first"), F.element_at("tokens", -1).alias("last"), pauses.alias("pauses"), *places)
    at = own.join(chapter_of.select(key, "paragraph_id", "chapter_index", "kind", "scene"), [key, "paragraph_id"], "left")
    w = Window.partitionBy(key).orderBy("paragraph_id")
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumns({"seq": F.coalesce(F.sum("n").over(ahead), F.lit(0)), "p": F.lag(F.struct("last", "chapter_index")).over(w), "first_chapter": F.first("chapter_index").over(w)})
    run = Window.partitionBy(key, "chapter_index").orderBy("paragraph_id").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("in_chapter", F.when(~F.col("chapter_index").eqNullSafe(F.col("first_chapter")), F.coalesce(F.sum("n").over(run), F.lit(0))))
    same = F.col("p.chapter_index").eqNullSafe(F.col("chapter_index"))
    between = G.priority_pause(G.structural_pause(F.col("p.last"), F.col("first"), no, same, F.col("kind"), F.coalesce("scene", no), tempo), F.col("p.last"), tempo)
    at = at.withColumn("begins", F.when(F.col("p").isNull(), 0).otherwise(between).cast("long"))
    ramp = lambda i: G.next_word_delay(F.lit(wpm), F.col("seq") + i, F.col("in_chapter") + i, tempo)
    delays = F.transform(F.concat(F.array(F.col("begins")), F.col("pauses").cast("array<bigint>")), lambda x, i: (x + ramp(i)).cast("long"))
    at = at.select(key, "paragraph_id", "seq", delays.alias("delays"), *places).withColumn("shown", running(F.col("delays")))
    at = at.withColumn("since", F.coalesce(F.sum(F.element_at("shown", -1)).over(ahead), F.lit(0)))
    each = at.select(key, "paragraph_id", "seq", "since", *places, F.posexplode(F.arrays_zip("delays", "shown")).alias("i", "d"))
    index = F.get("places", F.col("i")) if places else F.col("i")
    return each.select(key, "paragraph_id", index.alias("word_index"), (F.col("seq") + F.col("i")).alias("word_seq"), F.col("d.delays").alias("delay_ms"), (F.col("since") + F.col("d.shown")).alias("at_ms"))
