"""Books from their parts: chapters chosen among the lists of candidates, and paragraphs numbered anew with all that points at them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import model as M
from leafmill.operators.prefix import running_sum
from leafmill.sources import epub

#: The bucket and the messages of a weak choice.
BUCKET = "Weak / missing / nonsense chapters"
MESSAGES = {
    ("headings", True): ("warning", "Navigation targets collapsed to too few positions; headings were used as chapters"),
    ("headings", False): ("warning", "Navigation TOC was unavailable; headings were used as chapters"),
    ("files", True): ("failure", "Navigation targets collapsed and headings were unavailable; file boundaries are not trusted as chapters"),
    ("files", False): ("failure", "Navigation TOC and headings were unavailable; file boundaries are not trusted as chapters"),
    ("single", True): ("failure", "No trustworthy chapter structure was found"),
    ("single", False): ("failure", "No trustworthy chapter structure was found"),
}


def choose_chapters(entries: DataFrame, books: DataFrame, key: str = "book") -> tuple[DataFrame, DataFrame]:
    """(chapters, diagnostics): of each book the rows of the list that is trusted most, or one chapter with the book's title.

    ``entries``: key, source (nav, ncx, headings, files), ord, title, start_paragraph_id; ``books``: key, n (paragraphs), title. The lists are
    judged by one aggregate of narrow facts; the chosen rows are joined to it by (key, source), so no list is gathered.
    """
    clean = epub.cleaned(entries, books.select(key, "n"), key)
    choice = epub.choose_source(clean, books.select(key), key)
    kept = clean.join(choice.drop("collapsed"), [key, "source"]).select(key, "source", F.col("ord").cast("long").alias("ord"), "title", F.col("start_paragraph_id").cast("long").alias("start_paragraph_id"))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Start"))
    single = choice.where("source = 'single'").join(books, key).select(key, "source", F.lit(0).cast("long").alias("ord"), title.alias("title"), F.lit(1).cast("long").alias("start_paragraph_id"))
    said = F.lit(None).cast("struct<severity:string,message:string>")
    for (source, collapsed), (severity, message) in MESSAGES.items():
        said = F.when((F.col("source") == source) & (F.col("collapsed") == collapsed), F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message"))).otherwise(said)
    diagnostics = choice.withColumn("said", said).where("said IS NOT NULL").select(key, F.lit(BUCKET).alias("bucket"), "said.severity", "said.message")
    return kept.unionByName(single), diagnostics


@dataclass(frozen=True)
class Books:
    """The parts of books by paragraphs that are numbered from 1 without gaps."""

    paragraphs: DataFrame
    chapters: DataFrame
    images: DataFrame
    anchors: DataFrame
    totals: DataFrame


def renumbered(paragraphs: DataFrame, chapters: DataFrame, images: DataFrame, anchors: DataFrame, key: str = "book") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Paragraphs that hold text get the numbers 1..n in order of their places; what points at places follows in the same pass.

    Only (key, place, what) is ordered, not the texts. A chapter or an anchor goes to the first kept paragraph at or after its place, an image behind the
    last one at or before it (0 before the first). Paragraphs get their ``words`` and whether a ``chapter`` starts at them; counts come from them as (key, paragraphs, words).
    """
    none = F.lit(None)
    from leafmill.session import with_checkpoints

    with_checkpoints(paragraphs.sparkSession)
    kept = paragraphs.withColumn("text", T.normalize_text("text")).where("text <> ''").withColumn("words", T.count_words("text")).checkpoint()  # texts are looked into once
    rows = [
        kept.select(key, "place", F.lit(1).alias("what"), F.lit(0).cast("long").alias("ord"), none.cast("string").alias("path"), none.cast("string").alias("fragment")),
        chapters.select(key, "place", F.lit(0).alias("what"), F.col("ord").cast("long").alias("ord"), none.cast("string").alias("path"), none.cast("string").alias("fragment")),
        anchors.select(key, "place", F.lit(-1).alias("what"), F.lit(0).cast("long").alias("ord"), "path", "fragment"),
        images.select(key, "place", F.lit(2).alias("what"), F.col("ord").cast("long").alias("ord"), none.cast("string").alias("path"), none.cast("string").alias("fragment")),
    ]
    marks = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).withColumn("place", F.col("place").cast("long"))
    at = running_sum(marks, key, "place", [F.col("what"), F.col("ord")], (F.col("what") == 1).cast("long"), "upto").checkpoint()  # narrow, and read five times
    begins = at.where("what = 0").select(key, (F.col("upto") + 1).alias("id")).distinct().withColumn("chapter", F.lit(True))
    own = at.where("what = 1").select(key, "place", F.col("upto").alias("id")).join(begins, [key, "id"], "left")
    out = kept.join(own, [key, "place"])
    starts = at.where("what = 0").select(key, "ord", (F.col("upto") + 1).alias("start"))
    behind = at.where("what = 2").select(key, "ord", F.col("upto").alias("after"))
    targets = at.where("what = -1").select(key, "path", "fragment", "place", (F.col("upto") + 1).alias("id"))
    counts = kept.groupBy(key).agg(F.count("*").alias("paragraphs"), F.sum("words").alias("words"))
    return out, counts, chapters.drop("place").join(starts, [key, "ord"]), images.drop("place").join(behind, [key, "ord"]), targets


def build_books(books: DataFrame, paragraphs: DataFrame, chapters: DataFrame, images: DataFrame, anchors: DataFrame, key: str = "book") -> Books:
    """Books whose paragraphs, chapters, images and anchors agree.

    ``books``: key; ``paragraphs``: key, place, text, scene; ``chapters``: key, ord, title, place; ``images``: key, ord, alt, src, place;
    ``anchors``: key, path, fragment, place; places are whole numbers in reading order, one paragraph each. Empty paragraphs go, numbers close up.
    Chapters are cleaned and ordered, an image stands behind one of 0..n paragraphs, an anchor at one of 1..n. A scene break
    stays except at the first paragraph and where a chapter starts.
    """
    paras, sizes, at, pictures, targets = renumbered(paragraphs, chapters, images, anchors, key)
    counts = books.select(key).join(sizes, key, "left").na.fill(0).checkpoint()  # a row a book
    scene = F.when((F.col("id") > 1) & F.col("chapter").isNull(), F.col("scene"))
    paras = paras.select(key, "id", "text", scene.alias("scene"))
    listed = M.dedup_chapters(at.select(key, F.col("ord").alias("pos"), "title", F.col("start").alias("start_paragraph_id")), counts, key)
    limit = counts.select(key, "paragraphs")
    pictures = pictures.join(limit, key).select(key, "ord", T.normalize_text("alt").alias("alt"), "src", F.least("paragraphs", "after").alias("after_paragraph_id"))
    targets = targets.join(limit, key).select(key, "path", "fragment", "place", F.greatest(F.lit(1), F.least("paragraphs", "id")).alias("paragraph_id"))
    n = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    totals = counts.join(n(listed, "chapters"), key, "left").join(n(pictures, "images"), key, "left").join(n(paras.where("scene IS NOT NULL"), "scene_breaks"), key, "left").na.fill(0)
    return Books(paras, listed, pictures, targets, totals)


def epub_books(rows: DataFrame, key: str = "book") -> tuple[Books, DataFrame]:
    """(books, diagnostics) from the tagged rows of ``epub.read_epubs``; files that failed there are absent from the books.

    The rows are read several times: write them once before (``snapshot`` of a library, or a checkpoint).
    """
    of = lambda kind: rows.where(F.col("kind") == kind)
    paragraphs = of("paragraph").select(key, F.col("paragraph_id").cast("long").alias("place"), "text", F.nullif(F.col("extra"), F.lit("")).alias("scene"))
    counts = paragraphs.groupBy(key).agg(F.count("*").alias("n"))
    titles = of("metadata").where("extra = 'title'").groupBy(key).agg(F.first("text").alias("title"))
    books = counts.join(titles, key, "left").na.fill("", ["title"])
    anchors = of("anchor").select(key, "path", F.col("text").alias("fragment"), "paragraph_id", F.col("seq").alias("pos"))
    files = of("file").select(key, "path", "paragraph_id")
    lists = [of("heading").select(key, F.lit("headings").alias("source"), F.col("seq").alias("ord"), F.col("text").alias("title"), F.col("paragraph_id").alias("start_paragraph_id")), of("file").select(key, F.lit("files").alias("source"), F.col("seq").alias("ord"), F.col("text").alias("title"), F.col("paragraph_id").alias("start_paragraph_id"))]
    for source in ("nav", "ncx"):
        toc = of(source).select(key, F.col("seq").alias("ord"), F.col("text").alias("title"), "path", F.coalesce("extra", F.lit("")).alias("fragment"))
        lists.append(epub.toc_targets(toc, anchors, files, counts, key).select(key, F.lit(source).alias("source"), "ord", "title", "start_paragraph_id"))
    entries = lists[0].unionByName(lists[1]).unionByName(lists[2]).unionByName(lists[3])
    chapters, weak = choose_chapters(entries, books, key)
    images = of("image").select(key, F.col("seq").alias("ord"), F.col("text").alias("alt"), F.col("extra").alias("src"), F.col("paragraph_id").cast("long").alias("place"))
    made = build_books(books, paragraphs, chapters.select(key, "ord", "title", F.col("start_paragraph_id").alias("place")), images, anchors.select(key, "path", "fragment", F.col("paragraph_id").cast("long").alias("place")), key)
    given = of("diagnostic").select(key, F.col("extra").alias("bucket"), F.lit("failure").alias("severity"), F.col("text").alias("message"))
    return made, given.unionByName(weak)


def outline_tree(entries: DataFrame, key: str = "book") -> DataFrame:
    """Entries of a table of contents with parent_ord, the nearest entry before them of a smaller depth (null at the top), and last_ord, the last of
    those under them (their own where there is none).

    ``entries``: key, ord, depth; depths may leave levels out. No stack is kept: each entry asks, once for every depth of the book, for the last entry of that depth before
    it and the next one behind it; the latest of the shallower before is the parent, the first of those that are not deeper ends the subtree.
    """
    depths = entries.groupBy(key).agg(F.collect_set("depth").alias("depths"))
    asks = entries.select(key, "ord", "depth").join(depths, key).select(key, "ord", "depth", F.explode("depths").alias("lane"))
    lane = Window.partitionBy(key, "lane").orderBy("ord")
    own = F.when(F.col("lane") == F.col("depth"), F.col("ord"))
    before = F.last(own, ignorenulls=True).over(lane.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.first(own, ignorenulls=True).over(lane.rowsBetween(1, Window.unboundedFollowing))
    seen = asks.withColumns({"before": before, "behind": behind})
    found = seen.groupBy(key, "ord").agg(F.max(F.when(F.col("lane") < F.col("depth"), F.col("before"))).alias("parent_ord"), F.min(F.when(F.col("lane") <= F.col("depth"), F.col("behind"))).alias("end"))
    final = entries.groupBy(key).agg(F.max("ord").alias("final"))
    # the entry right before the end, as numbers may leave gaps
    previous = entries.select(key, F.col("ord").alias("end"), F.lag("ord").over(Window.partitionBy(key).orderBy("ord")).alias("previous"))
    at = entries.join(found, [key, "ord"]).join(previous, [key, "end"], "left").join(final, key)
    return at.withColumn("last_ord", F.coalesce("previous", "final")).drop("end", "previous", "final")


def outline_flatten(items: DataFrame, key: str = "book") -> DataFrame:
    """The items of a nested outline in reading order: (key, id, title, depth, ord from 1), those without a useful title or a destination left out.

    ``items``: key, id, parent (null at the top), position, title, destination. The way from the top to an item, as positions, orders the tree; it grows by doubling
    the steps (log of the depth in joins), so no level is walked one by one. An item under a missing parent or in a ring is not reached.
    """
    from leafmill.session import with_checkpoints

    with_checkpoints(items.sparkSession)
    step = F.array(F.struct("position", "id"))
    way = items.select(key, "id", F.col("parent").alias("up"), step.alias("way")).checkpoint()
    while not way.where("up IS NOT NULL").isEmpty():
        above = way.select(key, F.col("id").alias("up"), F.col("up").alias("next"), F.col("way").alias("head"))
        joined = way.join(above, [key, "up"], "left")
        # steps double, so a way longer than the table's depth can only be a ring
        moved = joined.where("up IS NULL OR head IS NOT NULL").select(key, "id", F.when(F.col("up").isNotNull(), F.col("next")).alias("up"), F.when(F.col("up").isNotNull(), F.concat("head", "way")).otherwise(F.col("way")).alias("way"))
        way = moved.where(F.size("way") == F.size(F.array_distinct("way"))).checkpoint()
    title = T.normalize_text("title")
    useful = (F.length(title).between(1, 240)) & ~title.rlike(r"(?i)^_?(?:hlk|toc)[0-9]+\z") & ~title.rlike(r"(?i)^ole_link[0-9]+\z") & F.col("destination").isNotNull()
    kept = way.select(key, "id", "way").join(items.where(useful).select(key, "id", title.alias("title"), "destination"), [key, "id"])
    return kept.select(key, "id", "title", "destination", F.size("way").alias("depth"), F.row_number().over(Window.partitionBy(key).orderBy("way")).alias("ord"))
