"""Chapter lists from tables of contents: kinds of titles, clean-up steps, choice of depth, audits.

A list is (book_id, pos, title, start, ...) in order of start; the steps are windows by book over short lists.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


PRIMARY = ("letter", "chapter", "numbered")


@F.pandas_udf(StringType())
def norm_dedup(s: pd.Series) -> pd.Series:
    """Decomposed, without combining marks, white space collapsed, lower case; Spark has no normalisation of its own."""
    import re
    import unicodedata

    def one(x):
        if x is None:
            return None
        # split() and \s agree on white space
        return " ".join((x if x.isascii() else marks.sub("", unicodedata.normalize("NFD", x))).split()).lower()

    marks = re.compile("[̀-ͯ]")
    return s.map(one)


def title_key_of(x: str | None) -> str | None:
    """What tells titles of printed books apart: compatibility forms unfolded (ligatures, wide digits), lower case, without "chapter" or "section" before it, letters and digits of all scripts only."""
    import re
    import unicodedata

    if x is None:
        return None
    t = unicodedata.normalize("NFKC", " ".join(x.replace("\u00ad", "").split())).lower()
    t = re.sub(r"^(?:chapter|section)\s+", "", t)
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in t).split())


@F.pandas_udf(StringType())
def title_key(s: pd.Series) -> pd.Series:
    """``title_key_of`` each text."""
    return s.map(title_key_of)


def norm_loose(norm: Column) -> Column:
    return F.trim(F.regexp_replace(norm, r"[^a-z0-9 ][^a-z0-9]*| [^a-z0-9]+", " "))


def within(a: Column, b: Column) -> Column:
    """Whether one of two normalised texts holds the other, as it is or by letters and digits alone. A text is made loose only where it has the other's first and last word."""
    la, lb = norm_loose(a), norm_loose(b)
    first = F.regexp_extract(a, "[a-z0-9]+", 0)
    return F.contains(b, a) | F.contains(a, b) | (F.contains(lb, first) & F.contains(lb, la)) | (F.contains(a, F.substring_index(lb, " ", 1)) & F.contains(a, F.substring_index(lb, " ", -1)) & F.contains(la, lb))


def title_match(para: Column, title: Column) -> Column:
    """Whether a normalised paragraph stands for a normalised title: equal, begins with it, with a mark, close in length, or by its number."""
    number, rest = F.regexp_extract(title, r"^([0-9]+)\.\s*(.+)$", 1), F.regexp_extract(title, r"^([0-9]+)\.\s*(.+)$", 2)
    by_number = (number != "") & ((para == number) | (para == F.concat(F.lit("chapter "), number)) | (para == rest))
    near = (F.length(para) < F.length(title) + 15) & F.contains(para, title)
    return (para != "") & (title != "") & ((para == title) | F.startswith(para, F.concat(title, F.lit(" "))) | (para == F.concat(title, F.lit("."))) | (para == F.concat(title, F.lit(","))) | near | by_number)


#: Titles of front matter.
FRONT = ("cover", "title page", "half title", "contents", "table of contents", "illustrations", "copyright", "copyright page", "dedication", "preface", "foreword", "introduction")


_END, _ON = "(?![a-z0-9_])", "(?=[a-z0-9_])"  # a word ends here; a word begins here
#: Beginnings of normalised titles and their kinds, the first that fits.
KINDS = (
    (f"letter{_END}", "letter"),
    (f"chapter{_END}", "chapter"),
    (f"book{_END}", "book"),
    (f"part{_END}", "part"),
    (rf"volume{_END}|vol\.{_ON}", "volume"),
    (rf"(?:first|second|third|fourth|fifth)\s+act{_END}", "act"),
    (f"act{_END}", "act"),
    (f"scene{_END}", "scene"),
    ("dramatis person", "dramatis"),
    (f"(?:prologue|epilogue|induction){_END}", "play-section"),
)
#: Characters of a normalised title that its beginnings need at most.
HEAD = 40
#: A title that begins with a number of its own.
NUMBERED = r"(?i)^(?:[ivxlcdm]+|[0-9]+)(?![A-Za-z0-9_])[.\-\x{2014}: ]+\S"


def chapter_kind(title: Column, book_title: Column) -> Column:
    """One of 13 kinds by the title and the book's title; both plain."""
    t, b = norm_dedup(title), norm_dedup(book_title)
    # no beginning that counts is longer than a head, and a pattern is held against each place of what it gets
    head, bare = F.substring(t, 1, HEAD), F.rtrim(t, F.lit(":.;,"))
    composite = book_title.rlike(r"[;:/]") | book_title.rlike(r"(?i)(?<![a-z0-9_])and other(?![a-z0-9_])")
    trimmed = F.trim(title)
    caps = (trimmed == F.upper(trimmed)) & trimmed.rlike("[A-Z]")
    front = bare.isin(*FRONT) | head.rlike(rf"^(?:{'|'.join(FRONT)}) ") | head.rlike(r"^(?:illustrated by |translated from |translated by |bibliographical note|original short stories)") | t.contains("short stories") | t.isin("prologue", "the prologue", "epilogue", "or")
    own = ~composite & (F.length(t) >= 5) & within(t, b) & ~caps
    out = F.when(trimmed.startswith("[") & trimmed.rlike(r"^\[\s*[A-Z]\s*\]\z"), "front").when(t.contains("project gutenberg") | t.contains("full license") | t.contains("copyright") | t.isin("the end", "finis"), "back").when(front | own, "front")
    for pattern, kind in KINDS:
        out = out.when(head.rlike(f"^(?:{pattern})"), kind)
    return out.when(F.substring(title, 1, 1).rlike("[0-9ivxlcdmIVXLCDM]") & title.rlike(NUMBERED), "numbered").otherwise("other")


#: How fit a kind is to stand for a start that several share.
FITNESS = {"chapter": 90, "letter": 85, "numbered": 75, "other": 60, "book": 45, "act": 40, "part": 35, "volume": 25, "dramatis": 15, "play-section": 15, "scene": 5}


def shared_start_score(kind: Column, norm: Column) -> Column:
    """How fit a title is to stand for a start that several share."""
    value = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FITNESS.items() for x in kv]), kind), F.lit(-50))
    return value - F.when(norm.startswith("by ") | norm.startswith("or, "), 10).otherwise(0) - F.when(F.length(norm) < 4, 10).otherwise(0)


def _book() -> Window:
    return Window.partitionBy("book_id")


def _order() -> Window:
    return _book().orderBy("start", "pos")


def drop_prelude(chapters: DataFrame) -> DataFrame:
    """Up to three entries before the first primary chapter go. ``chapters``: book_id, pos, start, kind, norm."""
    at = chapters.withColumn("i", F.row_number().over(_order()) - 1)
    first = F.min(F.when(F.col("kind").isin(*PRIMARY), F.col("i"))).over(_book())
    at = at.withColumn("first", first)
    return at.where(F.col("first").isNull() | ~F.col("first").between(1, 3) | (F.col("i") >= F.col("first"))).drop("i", "first")


def drop_wrappers(chapters: DataFrame) -> DataFrame:
    """Leading front, back and collection titles and (where the column ``fragment`` tells) pieces of title pages go, as long as they follow each other and one entry remains."""
    w = _order()
    piece = F.col("fragment") if "fragment" in chapters.columns else F.lit(False)
    at = chapters.withColumns({"gap": F.lead("start").over(w) - F.col("start"), "next_kind": F.lead("kind").over(w)})
    wrapper = F.col("kind").isin("front", "back") | piece | ((F.col("gap") <= 12) & (F.col("kind") == "other") & (F.col("next_kind") == "other") & F.col("norm").rlike(r"(?<![a-z])(?:trilogy|poems|plays|stories|essays|works)(?![a-z])"))
    goes = F.coalesce(wrapper, F.lit(False)) & F.col("gap").isNotNull()
    stays = F.sum((~goes).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return at.withColumn("stays", stays).where("stays > 0").drop("gap", "next_kind", "stays")


def drop_containers(chapters: DataFrame) -> DataFrame:
    """Front and back entries, parts right before their first chapter, and acts and scenes among other works go."""
    w, kind = _order(), F.col("kind")
    at = chapters.withColumns({"gap": F.lead("start").over(w) - F.col("start"), "next_kind": F.lead("kind").over(w), "primary": F.sum(kind.isin(*PRIMARY).cast("int")).over(_book()), "others": F.sum((kind == "other").cast("int")).over(_book())})
    part = kind.isin("part", "book", "volume") & (F.col("gap") <= 3) & F.col("next_kind").isin(*PRIMARY, "other") & ((kind == "volume") | (F.col("primary") >= 5))
    play = kind.isin("act", "scene", "dramatis", "play-section") & (F.col("others") >= 5)
    return at.where(~(kind.isin("front", "back") | F.coalesce(part, F.lit(False)) | play)).drop("gap", "next_kind", "primary", "others")


def drop_songs(chapters: DataFrame) -> DataFrame:
    """Songs and chants within two paragraphs of another entry go."""
    w = _order()
    song = F.contains("norm", F.lit("song")) | F.contains("norm", F.lit("chant"))
    at = chapters.withColumn("song", song)
    at = at.withColumns({"p": F.struct((F.col("start") - F.lag("start").over(w)).alias("gap"), F.lag("song").over(w).alias("song")), "n": F.struct((F.lead("start").over(w) - F.col("start")).alias("gap"), F.lead("song").over(w).alias("song"))})
    beside = lambda c: F.coalesce((F.col(f"{c}.gap") <= 2) & ~F.col(f"{c}.song"), F.lit(False))
    return at.where(~(F.col("song") & (beside("n") | beside("p")))).drop("song", "p", "n")


def later_repeats(chapters: DataFrame) -> DataFrame:
    """Of repeated titles that are no chapters of their own the latest stays."""
    by = Window.partitionBy("book_id", "norm")
    at = chapters.withColumns({"times": F.count("*").over(by), "latest": F.max("start").over(by), "first_kind": F.first("kind").over(by.orderBy("start", "pos"))})
    return at.where((F.col("times") == 1) | F.col("first_kind").isin(*PRIMARY, "front", "back") | (F.col("start") == F.col("latest"))).drop("times", "latest", "first_kind")


def depth_choice(toc: DataFrame) -> DataFrame:
    """(book_id, depth, n, median_gap) of the depth whose entries make the chapters: most entries, then widest, then shallowest, among depths of two or more whose median gap is 5 or more where there are such. ``toc``: book_id, depth, start."""
    gap = F.col("start") - F.lag("start").over(Window.partitionBy("book_id", "depth").orderBy("start"))
    stats = toc.withColumn("gap", gap).groupBy("book_id", "depth").agg(F.count("*").alias("n"), F.coalesce(F.median("gap"), F.lit(0.0)).alias("median_gap")).where("n >= 2")
    rank = F.struct((F.col("n") <= 1000).alias("bounded"), (F.col("median_gap") >= 5).alias("wide"), "n", "median_gap", (-F.col("depth")).alias("d"))
    best = stats.groupBy("book_id").agg(F.max(rank).alias("b"))
    return best.select("book_id", (-F.col("b.d")).alias("depth"), "b.n", "b.median_gap")


def audit(chapters: DataFrame, books: DataFrame, paragraphs: DataFrame | None = None) -> DataFrame:
    """(book_id, issues, status) of extracted chapters: rising starts up to the first fall, starts in range, leaked matter, one chapter beside a table of contents, starts at nothing or at a heading.

    ``chapters``: book_id, pos, start, norm; ``books``: book_id, paragraphs, and norm, entries, excluded where these are known; ``paragraphs``: book_id, paragraph_id, text.
    A chapter's preview is its first paragraph. Books with a reason in ``excluded`` are ``excluded``.
    """
    w = _book().orderBy("pos")
    names = set(books.columns)
    b = books.select("book_id", "paragraphs", *[(F.col(c) if c in names else F.lit(None).cast(k)).alias(f"__{c}") for c, k in (("norm", "string"), ("entries", "long"), ("excluded", "string"))])
    at = chapters.join(b, "book_id").withColumns({"prev": F.lag("start", 1, 0).over(w), "after": F.lead("start").over(w), "n": F.count("*").over(_book())})
    at = at.withColumn("falls", F.sum((F.col("start") <= F.col("prev")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if paragraphs is None:
        at = at.withColumns({"preview": F.lit(None).cast("string"), "behind": F.lit(None).cast("string"), "seen": F.lit(False)})
    else:
        here = paragraphs.select("book_id", F.col("paragraph_id").alias("start"), F.col("text").alias("preview"))
        behind = paragraphs.select("book_id", (F.col("paragraph_id") - 1).alias("start"), F.col("text").alias("behind"))
        at = at.join(here, ["book_id", "start"], "left").join(behind, ["book_id", "start"], "left").withColumn("seen", F.lit(True))
    scanned, out = F.col("falls") == 0, (F.col("start") < 1) | (F.col("start") > F.col("paragraphs"))
    back = F.col("norm").rlike(r"^(?:appendix|appendices|bibliography|index|notes|endnotes|footnotes|glossary|colophon)(?: |\z)")
    front = F.col("norm").rlike(r"^(?:contents|table of contents|copyright|copyright page|title page|cover|preface|foreword|introduction|dedication)(?: |\z)")
    blank = F.col("seen") & (F.trim(F.coalesce("preview", F.lit(""))) == "")
    same = (F.length(norm_dedup(F.col("preview"))) < 40) & (norm_dedup(F.col("preview")) == F.col("norm")) & (F.col("norm") != "")
    heading = F.coalesce(~blank & same & (F.length("behind") >= 40) & (F.col("after").isNull() | (F.col("start") + 1 < F.col("after"))), F.lit(False))
    alone = (F.col("__entries") > 4) & (F.col("n") == 1) & (F.col("norm") != F.col("__norm")) & (F.col("norm") != "full book")
    facts = at.groupBy("book_id").agg(
        F.max("falls").alias("f"), F.count_if(scanned & out).alias("o"), F.count_if(scanned & front & (F.col("n") > 1)).alias("fm"), F.count_if(scanned & back & (F.col("n") > 2)).alias("bm"),
        F.count_if(F.coalesce(alone, F.lit(False))).alias("a"), F.count_if(scanned & blank).alias("p"), F.count_if(scanned & heading).alias("h"),
    )
    j = b.join(facts, "book_id", "left")
    code = lambda cond, name: F.when(cond, name)
    codes = F.array_compact(F.array(code(F.col("paragraphs") == 0, "empty-paragraphs"), code(F.col("f").isNull(), "empty-chapters"), code(F.col("a") > 0, "single-chapter-with-toc"), code(F.col("f") > 0, "non-monotonic-starts"), code(F.col("o") > 0, "invalid-start-id"), code(F.col("fm") > 0, "front-matter-chapter"), code(F.col("bm") > 0, "back-matter-chapter"), code(F.col("p") > 0, "missing-preview"), code(F.col("h") > 0, "heading-only-start")))
    status = F.when(F.col("__excluded").isNotNull(), "excluded").when(F.size(codes) > 0, "flagged").otherwise("ok")
    return j.select("book_id", F.array_join(codes, ",").alias("issues"), status.alias("status"))


def cover_error(size: Column, mime: Column, width: Column, height: Column) -> Column:
    """The error code of an uploaded cover; null for a good one."""
    return F.when(size <= 0, "file_empty").when(size > 5 * 1024 * 1024, "file_too_large").when(~mime.isin("image/jpeg", "image/png", "image/webp"), "unsupported_format").when(width.isNull() | height.isNull(), "decode_failed").when((width < 120) | (height < 160), "dimensions_too_small")


def quarter_turn(items: DataFrame) -> DataFrame:
    """(book_id, page, rotation): 90 or 270 where 20 items and 120 characters, four fifths of the page, stand upright on their side. ``items``: book_id, page, chars, angle."""
    import math

    away = lambda to: F.abs(F.atan2(F.sin(F.col("angle") - to), F.cos(F.col("angle") - to)))
    turn = F.when(away(-math.pi / 2) <= math.radians(8), 90).when(away(math.pi / 2) <= math.radians(8), 270)
    sums = items.withColumn("turn", turn).groupBy("book_id", "page", "turn").agg(F.sum("chars").alias("c"), F.count("*").alias("n"))
    page = sums.groupBy("book_id", "page").agg(F.sum("c").alias("all"), F.max(F.when(F.col("turn").isNotNull(), F.struct("c", "n", (-F.col("turn")).alias("t")))).alias("b"))
    good = (F.col("b.n") >= 20) & (F.col("b.c") >= 120) & (F.col("b.c") / F.greatest(F.col("all"), F.lit(1)) >= 0.8)
    return page.select("book_id", "page", F.when(good, -F.col("b.t")).alias("rotation"))


def two_voices(voices: DataFrame) -> DataFrame:
    """The best female and the best male voice of each language, filled up by the next best. ``voices``: lang, index, name, gender, is_default, local."""
    score = F.when(F.col("is_default"), 4).otherwise(0) + F.when(F.col("local"), 2).otherwise(0) + F.when(F.trim("name") != "", 1).otherwise(0)
    rank = F.row_number().over(Window.partitionBy("lang", "gender").orderBy(F.desc("score"), "index"))
    at = voices.withColumn("score", score).withColumn("rank", rank)
    group = F.when((F.col("gender") == "female") & (F.col("rank") == 1), 0).when((F.col("gender") == "male") & (F.col("rank") == 1), 1).when(F.col("gender") == "unknown", 2).when(F.col("gender") == "female", 3).otherwise(4)
    picked = F.row_number().over(Window.partitionBy("lang").orderBy(group, "rank"))
    return at.withColumn("n", picked).where("n <= 2").select("lang", "index", "score")
