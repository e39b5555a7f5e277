"""Chapters of packages whose table of contents says little: classes of entries, look-ups of their targets, and what can be recovered from texts.

Entries are (book_id, ord, title, file, anchor, depth); paragraphs (book_id, paragraph_id, text, file); books (book_id, title). Titles are normalised once and
carried along. All look-ups are equi-joins on keys; where a key may be ambiguous, its uniqueness is an aggregate joined beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import chapters as C
from leafmill.operators import geometry as G
from leafmill.session import with_checkpoints

#: Types of landmarks, by what they say of a target.
LANDMARKS = {
    "main": ("bodymatter", "text", "chapter", "part", "volume"),
    "front": ("cover", "title-page", "titlepage", "halftitlepage", "imprint", "copyright-page", "copyrightpage", "toc", "dedication", "preface", "foreword"),
    "back": ("appendix", "appendices", "glossary", "bibliography", "index", "notes", "footnotes", "endnotes", "colophon", "loa", "loi"),
}
#: Titles of back matter.
BACK = ("appendix", "appendices", "glossary", "bibliography", "index", "notes", "footnotes", "endnotes", "colophon", "license", "licence")
#: Order of an entry that stands in no table of contents.
LAST = (1 << 31) - 1


def path_key(c: str | Column) -> Column:
    """A path as look-ups have it: plain slashes, no leading steps or container folder, lower case."""
    p = F.regexp_replace(F.coalesce(T.col(c), F.lit("")), r"\\", "/")
    for start in (r"^\./", r"^(?:\.\./)+", r"(?i)^OEBPS/", r"(?i)^OPS/"):
        p = F.regexp_replace(p, start, "")
    return F.lower(p)


def file_name(c: str | Column) -> Column:
    return F.substring_index(path_key(c), "/", -1)


def _begins(norm: Column, titles: tuple[str, ...]) -> Column:
    return norm.rlike(rf"^(?:{'|'.join(titles)})(?: |\z)")


def classify_toc(entries: DataFrame, references: DataFrame, books: DataFrame) -> DataFrame:
    """Adds ``category`` (main, front, back, unknown): by the landmarks of an entry's target, else of its file, else by its title.

    ``references``: book_id, pos, type, file, anchor. Of several landmarks the first counts whose type is known.
    """
    category = F.lit(None).cast("string")
    for name, types in LANDMARKS.items():
        category = F.when(F.col("type").isin(*types), name).otherwise(category)
    known = references.select("book_id", "pos", path_key("file").alias("__file"), F.lower(F.coalesce("anchor", F.lit(""))).alias("__anchor"), category.alias("c")).where("c IS NOT NULL")
    target = known.groupBy("book_id", "__file", "__anchor").agg(F.min_by("c", "pos").alias("__by_target"))
    file = known.groupBy("book_id", "__file").agg(F.min_by("c", "pos").alias("__by_file"))
    at = entries.withColumns({"__file": path_key("file"), "__anchor": F.lower(F.coalesce("anchor", F.lit(""))), "__norm": C.norm_dedup(F.col("title"))})
    at = at.join(target, ["book_id", "__file", "__anchor"], "left").join(file, ["book_id", "__file"], "left").join(books.select("book_id", C.norm_dedup(F.col("title")).alias("__book")), "book_id", "left")
    bare = F.regexp_replace("__norm", r"[:.;,]+\z", "")
    by_title = F.when(((F.col("__norm") == F.col("__book")) & (F.col("ord") <= 2)) | _begins(bare, C.FRONT), "front").when(_begins(bare, BACK), "back").otherwise("unknown")
    return at.withColumn("category", F.coalesce("__by_target", "__by_file", by_title)).drop("__file", "__anchor", "__norm", "__book", "__by_target", "__by_file")


def anchored_entries(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """(book_id, block, ord): the entries whose anchors stand in a block, by its file, or by its bare name where the table of contents has the name once and the file not at all.

    ``blocks``: book_id, block, file, anchors (an array).
    """
    e = entries.select("book_id", "ord", path_key("file").alias("file"), file_name("file").alias("name"), F.lower("anchor").alias("anchor"))
    times = e.groupBy("book_id", "name").agg(F.count("*").alias("times"))
    with_anchor = e.where("anchor <> ''")
    unique = with_anchor.join(times.where("times = 1").select("book_id", "name"), ["book_id", "name"]).select("book_id", "name", "anchor", F.col("ord").alias("by_name"))
    listed = with_anchor.select("book_id", "file").distinct().withColumn("listed", F.lit(True))
    b = blocks.select("book_id", "block", path_key("file").alias("file"), file_name("file").alias("name"), F.explode(F.array_distinct(F.transform("anchors", F.lower))).alias("anchor"))
    b = b.join(listed, ["book_id", "file"], "left")
    exact = b.where("listed").join(with_anchor.select("book_id", "file", "anchor", "ord"), ["book_id", "file", "anchor"]).select("book_id", "block", "ord")
    by_name = b.where("listed IS NULL").join(unique, ["book_id", "name", "anchor"]).select("book_id", "block", F.col("by_name").alias("ord"))
    return exact.unionByName(by_name).distinct()


def title_fragment(title: Column, book_title: Column) -> Column:
    """Whether a title is a piece of a title page: a joining word, or a part of the book's title."""
    t, b = C.norm_dedup(title), C.norm_dedup(book_title)
    composite = book_title.rlike(r"[;:/]") | book_title.rlike(r"(?i)(?<![a-z0-9_])and other(?![a-z0-9_])")
    trimmed = F.trim(title)
    caps = (trimmed == F.upper(trimmed)) & trimmed.rlike("[A-Z]")
    joins = t.isin("or", "of") | t.rlike("^(?:or, |and |by |given in )")
    within = ~composite & (F.length(t) >= 5) & C.within(t, b)
    return ~caps & (joins | within)


def described(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """Chapters or entries (book_id, title and others) with kind, norm and fragment."""
    at = chapters.join(books.select("book_id", F.col("title").alias("__book")), "book_id")
    return at.withColumns({"kind": C.chapter_kind(F.col("title"), F.col("__book")), "norm": C.norm_dedup(F.col("title")), "fragment": title_fragment(F.col("title"), F.col("__book"))}).drop("__book")


def shift_past_headings(chapters: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Starts at a heading that is followed by text move to the text, unless the next chapter starts there.

    A paragraph is a heading if it stands for the title or is short and all in capitals. ``chapters``: book_id, pos, start, title, norm.
    """
    after = F.lead("start").over(Window.partitionBy("book_id").orderBy("start", "pos"))
    p = paragraphs.select("book_id", "paragraph_id", "text")
    here = p.select("book_id", F.col("paragraph_id").alias("start"), F.col("text").alias("__here"))
    behind = p.select("book_id", (F.col("paragraph_id") - 1).alias("start"), F.col("text").alias("__behind"))
    at = chapters.withColumn("__after", after).join(here, ["book_id", "start"], "left").join(behind, ["book_id", "start"], "left")
    h, b = C.norm_dedup(F.col("__here")), C.norm_dedup(F.col("__behind"))
    heading = (h == F.col("norm")) | C.title_match(h, F.col("norm")) | ((F.length("__here") <= 80) & (F.col("__here") == F.upper("__here")))
    body = (b != F.col("norm")) & (F.length(F.trim("__behind")) >= 2)
    free = F.col("__after").isNull() | (F.col("start") + 1 < F.col("__after"))
    moves = F.coalesce(heading & body & free, F.lit(False))
    return at.withColumn("start", F.when(moves, F.col("start") + 1).otherwise(F.col("start"))).drop("__after", "__here", "__behind")


def best_per_start(chapters: DataFrame) -> DataFrame:
    """One chapter a start, by the fitness of its kind, the longer title, the earlier entry."""
    names = [c for c in chapters.columns if c not in ("book_id", "start")]
    rank = F.struct(C.shared_start_score(F.col("kind"), F.col("norm")).alias("s"), F.length("title").alias("n"), (-F.col("pos")).alias("p"))
    return chapters.groupBy("book_id", "start").agg(F.max_by(F.struct(*names), rank).alias("b")).select("book_id", "start", "b.*")


def finalize(chapters: DataFrame, paragraphs: DataFrame, books: DataFrame) -> DataFrame:
    """The clean list of chapters (book_id, pos, start, title, kind, norm): the best of each start, without prelude, wrappers, containers, song companions and early repeats, moved past headings.

    ``chapters``: book_id, pos, start, title.
    """
    at = best_per_start(described(chapters, books))
    for step in (C.drop_prelude, C.drop_wrappers, C.drop_containers):
        at = step(at)
    at = shift_past_headings(at, paragraphs)
    for step in (C.drop_songs, C.later_repeats, C.drop_wrappers):
        at = step(at)
    return best_per_start(at).select("book_id", "pos", "start", "title", "kind", "norm")


def reference_style(norm: Column) -> Column:
    """Titles of reference works and wrappers that no chapter has."""
    return norm.rlike(r"^section [0-9]+(?![a-z0-9_])") | norm.rlike(r"^year: [0-9]{4}(?![a-z0-9_])") | (norm == "top") | norm.startswith("the full project gutenberg")


def implicit_headings(paragraphs: DataFrame, entries: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, start, title, depth, ord, category, kind): paragraphs that head a chapter though nothing points at them.

    A short paragraph that begins with "chapter" and has another behind it, or one that is an entry's title in the entry's file. ``entries``: as ``described`` and ``classify_toc`` give them
    (book_id, ord, title, file, depth, category, kind, norm, fragment).
    """
    # all is judged where the paragraph meets its book; the look-up of titles by digests takes a text along only where it may be the title
    behind = F.count("*").over(Window.partitionBy("book_id").orderBy(F.col("paragraph_id").cast("long")).rangeBetween(1, 1)) > 0
    p = paragraphs.withColumn("more", behind).join(books.select("book_id", F.col("title").alias("__book")), "book_id").withColumns({"norm": C.norm_dedup(F.col("text")), "kind": C.chapter_kind(F.trim("text"), F.col("__book"))})
    digest = F.unhex(F.md5(F.col("norm").cast("binary"))).alias("digest")
    named = entries.where(~(F.col("kind").isin("front", "back") | F.col("fragment")) & ~reference_style(F.col("norm")))
    first = named.select("book_id", digest, "title", path_key("file").alias("file"), "depth", "ord", "category").groupBy("book_id", "digest").agg(F.min_by(F.struct("title", "file", "depth", "ord", "category"), "ord").alias("e"))
    text = F.trim("text")
    says = (F.col("kind") == "chapter") & (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) <= 24) & (F.length(text) <= 180) & F.col("more")
    narrow = p.withColumn("says", F.coalesce(says, F.lit(False)))
    narrow = narrow.select("book_id", "paragraph_id", path_key("file").alias("file"), F.length("text").alias("n"), "kind", "says", F.when(F.col("says"), F.col("text")).alias("text"), digest)
    at = narrow.join(first, ["book_id", "digest"], "left")
    listed = F.col("e").isNotNull() & (F.col("e.file") == F.col("file")) & (F.col("n") <= F.length("e.title") + 40)
    kept = at.where(F.col("says") | F.coalesce(listed, F.lit(False)))
    return kept.select("book_id", F.col("paragraph_id").alias("start"), F.coalesce("e.title", "text").alias("title"), F.coalesce("e.depth", F.lit(1)).alias("depth"), F.coalesce("e.ord", F.lit(LAST)).cast("long").alias("ord"), F.coalesce("e.category", F.lit("unknown")).alias("category"), F.col("kind"))


def recovery_candidates(entries: DataFrame, paragraphs: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, source, ord, start, title, depth, category): acts at the top, works of repeated titles, entries matched by text, implicit headings.

    ``entries``: described and classified.
    """
    starts = paragraphs.groupBy("book_id", path_key("file").alias("__file")).agg(F.min("paragraph_id").alias("start")).checkpoint()  # a row a file, read four times
    open_ = entries.where(~F.col("category").isin("front", "back")).withColumn("__file", path_key("file"))
    out = ["book_id", "source", "ord", "start", "title", "depth", "category"]
    by_book = Window.partitionBy("book_id")
    placed = lambda df, source: df.join(starts, ["book_id", "__file"]).withColumn("source", F.lit(source)).select(out)
    acts = open_.where("kind = 'act'").withColumns({"n": F.count("*").over(by_book), "top": F.min("depth").over(by_book)}).where("n >= 2 AND depth = top")
    pool = open_.where(~(F.col("kind").isin("front", "back") | F.col("fragment")) & ~reference_style(F.col("norm")))
    works = pool.where("kind = 'other'").withColumns({"n": F.count("*").over(by_book), "top": F.min("depth").over(by_book)}).where("n >= 2 AND depth = top")
    names = [c for c in works.columns if c not in ("book_id", "norm")]
    repeated = works.groupBy("book_id", "norm").agg(F.count("*").alias("times"), F.max_by(F.struct(*names), "ord").alias("e")).where("times >= 2").select("book_id", "norm", "e.*")
    repeated = repeated.withColumn("groups", F.count("*").over(by_book)).where("groups >= 2")
    total = paragraphs.groupBy("book_id").agg(F.count("*").alias("total"))
    files = starts.select("book_id", "__file", (F.rank().over(Window.partitionBy("book_id").orderBy("start")) - 1).alias("spine"))
    contexts = paragraphs.select("book_id", "paragraph_id", "text", path_key("file").alias("file"))
    scored = G.toc_scored_match(pool.select("book_id", "ord", "title", F.col("__file").alias("file"), "kind"), contexts, files.join(total, "book_id").withColumnRenamed("__file", "file"))
    matched = pool.join(scored, ["book_id", "ord"]).withColumns({"source": F.lit("matched"), "start": F.col("paragraph_id")}).select(out)
    implicit = implicit_headings(paragraphs, entries, books).withColumn("source", F.lit("implicit")).select(out)
    return placed(acts, "act").unionByName(placed(repeated, "repeated")).unionByName(matched).unionByName(implicit)


def recover_collapsed(chapters: DataFrame, entries: DataFrame, paragraphs: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, start, title): the chapters, and for a book whose long table of contents came down to one chapter what can be recovered, if that is two or more.

    ``chapters``: book_id, pos, start, title; ``entries``: book_id, ord, title, file, anchor, depth, category. The single chapter must be neither the book's title nor a chapter, letter, book, part or the like.
    """
    with_checkpoints(chapters.sparkSession)
    own = described(chapters, books).withColumn("n", F.count("*").over(Window.partitionBy("book_id"))).where("n = 1")
    size = entries.groupBy("book_id").agg(F.count("*").alias("entries")).where("entries > 4")
    norm = books.select("book_id", C.norm_dedup(F.col("title")).alias("__book"))
    tries = own.join(size, "book_id").join(norm, "book_id").where((F.col("norm") != F.col("__book")) & (F.col("norm") != "full book") & F.col("kind").isin("front", "back", "other", "numbered", "scene")).select("book_id").checkpoint()
    mine = lambda df: df.join(tries, "book_id", "left_semi")
    # each of these is read by several steps; without a cut every step would make them anew
    e, texts = described(mine(entries), books).checkpoint(), mine(paragraphs).checkpoint()
    found = recovery_candidates(e, texts, books).checkpoint()
    by = Window.partitionBy("book_id")
    inner = found.withColumn("inner", F.sum((~F.col("category").isin("front", "back")).cast("int")).over(by))
    pool = inner.where((F.col("inner") < 2) | ~F.col("category").isin("front", "back"))
    depth = C.depth_choice(pool.select("book_id", "depth", "start")).select("book_id", F.col("depth").alias("chosen"))
    rank = F.when(F.col("source") == "act", 0).when(F.col("source") == "repeated", 1).when(F.col("source") == "matched", 2).otherwise(3)
    kept = pool.join(depth, "book_id", "left").where("chosen IS NULL OR depth = chosen").withColumn("pos", F.row_number().over(by.orderBy(rank, "ord", "start")))
    listed = C.later_repeats(described(kept.select("book_id", "pos", "start", "title"), books)).select("book_id", "pos", "start", "title")
    final = finalize(listed, texts, books).withColumn("n", F.count("*").over(by)).where("n >= 2").checkpoint()
    done = final.select("book_id").distinct()
    return chapters.join(done, "book_id", "left_anti").select("book_id", "start", "title").unionByName(final.select("book_id", "start", "title"))


def prefer_implicit(chapters: DataFrame, entries: DataFrame, paragraphs: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, start, title): where a book has at most five chapters and none of them primary, the headings that say "chapter", if texts and entries hold five.

    ``entries``: book_id, ord, title, start (of their targets).
    """
    with_checkpoints(chapters.sparkSession)
    own = described(chapters, books).groupBy("book_id").agg(F.count("*").alias("n"), F.bool_or(F.col("kind").isin(*C.PRIMARY)).alias("primary"))
    tries = books.join(own, "book_id", "left").where("coalesce(n, 0) <= 5 AND NOT coalesce(primary, false)").select("book_id").checkpoint()
    mine = lambda df: df.join(tries, "book_id", "left_semi")
    none = mine(entries).select("book_id", "ord", "title", F.lit("").alias("file"), F.lit(1).alias("depth"), F.lit("").alias("category"), F.lit("").alias("kind"), F.lit("").alias("norm"), F.lit(False).alias("fragment")).where("false")
    texts = mine(paragraphs).checkpoint()
    implicit = implicit_headings(texts, none, books).where("kind = 'chapter'").checkpoint()
    enough = implicit.groupBy("book_id").count().where("count >= 5").select("book_id")
    listed = described(mine(entries).withColumn("pos", F.col("ord")), books).where("kind = 'chapter'").select("book_id", F.col("ord").cast("long").alias("pos"), "start", "title")
    both = listed.unionByName(implicit.select("book_id", (F.col("start").cast("long") + LAST).alias("pos"), "start", "title")).join(enough, "book_id", "left_semi")
    final = finalize(both, texts, books).withColumn("n", F.count("*").over(Window.partitionBy("book_id"))).where("n >= 5").checkpoint()
    done = final.select("book_id").distinct()
    return chapters.join(done, "book_id", "left_anti").select("book_id", "start", "title").unionByName(final.select("book_id", "start", "title"))
