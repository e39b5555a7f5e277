"""Speech chunks: greedy packing of words, character ranges, and lookup of a character's word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill import schemas as S
from leafmill.functions import text as T


def packed(tokens: Column, limit: int = S.UTTERANCE_CHARS) -> Column:
    """Start character and chunk number of each token under greedy packing: array<struct<chunk, start, end, word>>.

    A chunk takes words and the blanks between while they fit; a longer word stands alone. The state of the fold is the end
    of the current chunk and its number, so it is one pass over the array.
    """
    kind = "struct<chunk:int,cursor:int,rows:array<struct<chunk:int,start:int,end:int,word:string>>>"
    zero = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("cursor"), F.array().cast("array<struct<chunk:int,start:int,end:int,word:string>>").alias("rows")).cast(kind)

    def add(s: Column, w: Column) -> Column:
        gap = F.when(s["cursor"] > 0, 1).otherwise(0)
        full = (s["cursor"] + gap + F.length(w) > limit) & (s["cursor"] > 0)
        chunk = s["chunk"] + full.cast("int")
        start = F.when(full, 0).otherwise(s["cursor"] + gap)
        row = F.struct(chunk.alias("chunk"), start.alias("start"), (start + F.length(w)).alias("end"), w.alias("word"))
        return F.struct(chunk.alias("chunk"), (start + F.length(w)).alias("cursor"), F.concat(s["rows"], F.array(row)).alias("rows")).cast(kind)

    return F.aggregate(tokens, zero, add, lambda s: s["rows"])


def speech_words(paras: DataFrame, limit: int = S.UTTERANCE_CHARS, key: str = "doc_id") -> DataFrame:
    """Each word's chunk within its paragraph and its character range; folded inside the paragraph's array, no shuffle."""
    return paras.select(key, "paragraph_id", F.posexplode(packed(T.tokenize("text"), limit)).alias("word_index", "r")).select(key, "paragraph_id", "word_index", "r.chunk", "r.start", "r.end", "r.word")


def chunk_texts(joined: Column, n_words: Column, limit: int = S.UTTERANCE_CHARS) -> Column:
    """The chunks of greedy packing of words joined by blanks, as array<struct<text, n_words>>.

    What fits one chunk is taken whole; else one pattern walks over the text: as many characters as fit and end at a blank, or a longer word alone.
    """
    whole = F.array(F.struct(joined.alias("text"), n_words.alias("n_words")))
    cut = F.regexp_extract_all(joined, F.lit(rf"(?s).{{1,{limit}}}(?: |\z)|[^ ]+(?: |\z)"), F.lit(0))
    row = lambda c: F.struct(F.rtrim(c).alias("text"), (F.length(F.rtrim(c)) - F.length(F.replace(F.rtrim(c), F.lit(" "), F.lit(""))) + 1).alias("n_words"))
    return F.when(F.length(joined) <= limit, whole).otherwise(F.transform(cut, row))


def speech_chunks(paras: DataFrame, limit: int = S.UTTERANCE_CHARS, key: str = "doc_id") -> DataFrame:
    """(key, paragraph_id, chunk, text, n_words); built inside each paragraph's row, no shuffle. Paragraphs without words go at the end only: a filter before it would cut the words twice."""
    tokens = paras.select(key, "paragraph_id", T.tokenize("text").alias("tokens"))
    joined = tokens.select(key, "paragraph_id", F.array_join("tokens", " ").alias("joined"), F.size("tokens").alias("n"))
    made = joined.select(key, "paragraph_id", F.posexplode(chunk_texts(F.col("joined"), F.col("n"), limit)).alias("chunk", "c"))
    return made.select(key, "paragraph_id", "chunk", "c.text", "c.n_words").where("n_words > 0")


def spoken_plan(paras: DataFrame, starts: DataFrame, limit: int = S.UTTERANCE_CHARS, key: str = "doc_id") -> DataFrame:
    """What is spoken from a position on: (key, paragraph_id, chunk, text, start_word, n_words, pause_before_ms, ranges).

    ``paras``: key, paragraph_id, text, pause_ms (before the paragraph); ``starts``: key, paragraph_id, word_index; a paragraph that the book lacks counts as its first. A chunk never crosses paragraphs; the
    first chunk of each paragraph but the one where speech starts waits for the pause. ``ranges`` holds the characters of each word in its chunk.
    """
    where = starts.select(key, F.col("paragraph_id").alias("__at"), F.col("word_index").alias("__word"))
    found = paras.join(where, key).groupBy(key).agg(F.max(F.when(F.col("paragraph_id") == F.col("__at"), F.col("paragraph_id"))).alias("__known"), F.min("paragraph_id").alias("__first"), F.max("__word").alias("__word"))
    begin = found.select(key, F.coalesce("__known", "__first").alias("__begin"), F.greatest(F.lit(0), F.col("__word")).cast("int").alias("__word"))
    ahead = paras.join(begin, key).where("paragraph_id >= __begin").withColumn("__skip", F.when(F.col("paragraph_id") == F.col("__begin"), F.col("__word")).otherwise(0))
    tokens = ahead.select(key, "paragraph_id", "pause_ms", "__begin", "__skip", T.tokenize("text").alias("__tokens"))
    left = F.greatest(F.size("__tokens") - F.col("__skip"), F.lit(0))
    spoken = F.array_join(F.slice("__tokens", F.col("__skip") + 1, left), " ")
    # cut by one pattern; only the numbers of words of the chunks are summed up in a fold
    made = tokens.select(key, "paragraph_id", "pause_ms", "__begin", "__skip", left.alias("__left"), spoken.alias("__spoken"))
    made = made.select(key, "paragraph_id", "pause_ms", "__begin", F.posexplode(_started(chunk_texts(F.col("__spoken"), F.col("__left"), limit), F.col("__skip"))).alias("chunk", "__c")).where("__c.n_words > 0")
    pause = F.when((F.col("chunk") == 0) & (F.col("paragraph_id") > F.col("__begin")), F.col("pause_ms")).otherwise(0)
    return made.select(key, "paragraph_id", "chunk", "__c.text", "__c.start_word", "__c.n_words", pause.alias("pause_before_ms"), chunk_ranges(F.col("__c.text"), F.col("__c.start_word")).alias("ranges"))


def _started(chunks: Column, skip: Column) -> Column:
    """Chunks with the place of each one's first word, ``skip`` for the first."""
    kind = "struct<at:int,rows:array<struct<text:string,n_words:int,start_word:int>>>"
    zero = F.struct(skip.cast("int").alias("at"), F.array().cast("array<struct<text:string,n_words:int,start_word:int>>").alias("rows")).cast(kind)
    add = lambda s, c: F.struct((s["at"] + c["n_words"]).alias("at"), F.concat(s["rows"], F.array(F.struct(c["text"].alias("text"), c["n_words"].alias("n_words"), s["at"].alias("start_word")))).alias("rows")).cast(kind)
    return F.when(F.size(chunks) > 1, F.aggregate(chunks, zero, add, lambda s: s["rows"])).otherwise(F.transform(chunks, lambda c: F.struct(c["text"].alias("text"), c["n_words"].alias("n_words"), skip.cast("int").alias("start_word"))))


def chunk_ranges(text: Column, start_word: Column) -> Column:
    """The characters of each word of a chunk, array<struct<start, end, word_index>>; a fold over the words of one chunk, which its limit bounds."""
    kind = "struct<at:int,rows:array<struct<start:int,end:int,word_index:int>>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,word_index:int>>").alias("rows")).cast(kind)

    def add(s: Column, w: Column) -> Column:
        end = s["at"] + F.length(w)
        return F.struct((end + 1).alias("at"), F.concat(s["rows"], F.array(F.struct(s["at"].alias("start"), end.alias("end"), (start_word + F.size(s["rows"])).alias("word_index")))).alias("rows")).cast(kind)

    return F.aggregate(F.split(text, " "), zero, add, lambda s: s["rows"])


def word_at(joined: Column, offset: Column) -> Column:
    """``char_to_word`` where the words, joined by blanks, and the character are in one row: the blanks before the character."""
    before = F.substring(joined, F.lit(1), F.greatest(offset, F.lit(0)).cast("int"))
    blanks = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))
    return blanks


def char_to_word(ranges: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """The word at a character, or the last one before it in a gap, or the first one.

    Keys (book, chunk) are equal on both sides, so it is an equi-join of bounded groups: a chunk holds ``limit`` characters at
    most. ``ranges``: keys, word_index, start, end; ``offsets``: keys, offset.
    """
    listed = ranges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "word_index"))).alias("r"))
    at_or_before = F.filter("r", lambda x: x["start"] <= F.col("offset"))
    return offsets.join(listed, keys).select(*keys, "offset", F.get("r", F.greatest(F.size(at_or_before) - 1, F.lit(0)))["word_index"].alias("word_index"))


def rebuilt(ranges: Column) -> Column:
    """Text of transformed tokens: a blank inside a paragraph, a line end between paragraphs. ``ranges``: array<struct<paragraph_id, word>>."""
    return F.aggregate(
        ranges,
        F.struct(F.lit("").alias("t"), F.lit(-1).alias("p")),
        lambda s, r: F.struct(F.concat(s["t"], F.when(s["p"] == -1, "").when(s["p"] == r["paragraph_id"], " ").otherwise("\n"), r["word"]).alias("t"), r["paragraph_id"].alias("p")),
        lambda s: s["t"],
    )


def bounded(original: Column, changed: Column, limit: int = S.TRANSFORMED_CHARS) -> Column:
    """The changed text, unless it is longer than the limit: then the original."""
    return F.when(F.length(changed) > limit, original).otherwise(changed)
