"""Structure of positioned text: headings and paragraphs joined, scene breaks, chapter headings inside prose, places of images.

Draft paragraphs are rows (book_id, page, para, heading, text, lines); ``lines`` are the printed lines, an array of
(text, col, baseline, font_size, x_min, x_max), in order. ``heading`` is null, ``strong`` or ``typographic``. Windows over a whole book hold narrow rows
of pages, markers, titles or paragraph facts, never lines or texts.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from leafmill.functions import text as T
from leafmill.operators.chapters import title_key, title_key_of
from leafmill.operators.geometry import alike

LINE = "struct<text:string,col:int,baseline:double,font_size:double,x_min:double,x_max:double>"
#: Ends and beginnings of sentences, ornaments and what may stand between them.
ENDS = r"[.!?\x{2026}:\x{201D}\x{2019})]\z"
BEGINS = r"^[\p{Lu}\x{201C}\x{2018}\[]"
MARKS = r"[*\x{2042}\x{2022}\x{25C6}\x{25C7}\x{25CA}\x{2766}\x{2767}\x{00B7}]"
SEPARATORS = r"[\s*\x{2042}\x{2022}\x{25C6}\x{25C7}\x{25CA}\x{2766}\x{2767}\x{00B7}\x{2014}\x{2013}_-]"
LONE = r"^[\x{2042}\x{2766}\x{2767}]\z"
#: What begins a heading of its own.
OWN_HEADING = r"(?i)^(?:chapter|book|part|section|prologue|epilogue|appendix)(?![A-Za-z0-9_])|^(?:\p{N}{1,3}(?:\.\p{N}{1,3})*|[ivxlcdm]+)[.)]?\s+"


def joined(texts: Column) -> Column:
    """Wrapped texts as one: a hyphen between a letter and a small letter is a word break and goes."""
    parts = F.filter(F.transform(texts, T.normalize_text), lambda x: x != "")
    breaks = lambda x, after: F.substring(x, -2, 2).rlike(r"\p{L}[-\x{2010}]\z") & F.substring(after, 1, 1).rlike(r"^\p{Ll}")
    # what stands at a seam is told by the two texts beside it, so nothing grows and the work is linear
    piece = lambda x, after: F.when(after.isNull(), x).when(breaks(x, after), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(F.concat(x, F.lit(" ")))
    return F.get(F.transform(F.array(parts), lambda p: F.array_join(F.transform(p, lambda x, i: piece(x, F.get(p, i + 1))), "")), F.lit(0))


_NUMBER = rf"(?:\p{{N}}{{1,3}}|[ivxlcdm]{{1,8}}|{'|'.join(T.NUMBER_WORDS)})"
#: Headings that name a numbered part, the sections that stand alone, and those that do if they are set apart.
NUMBERED_PART = rf"(?is)^(?:chapter|book|part|section)\s+{_NUMBER}(.*)\z"
ALONE = r"(?is)^(?:prologue|epilogue|contents|acknowledge?ments?|preface(?:\s+and\s+acknowledge?ments?)?|foreword|afterword|appendix(?:\s+(?:\p{N}{1,3}|[a-z]|[ivxlcdm]{1,8}))?)(?:\s*[:.\-\x{2014}]\s*.*)?\z"
SET_APART = r"(?i)^(?:introduction|prologue|epilogue|preface|foreword|afterword|appendix)(?![A-Za-z0-9_])"
NUMBERED_TITLE = r"(?i)^(?:\p{N}{1,3}|[ivxlcdm]{1,8})[.)]?\s+[\p{Lu}\p{Ll}\p{Lt}]"


def explicit_heading(text: Column, emphasized: Column) -> Column:
    """Whether a line is a heading by what it says: a numbered part (with nothing or a mark behind it, or set apart), a section of its own, or a numbered title that is set apart."""
    t = T.normalize_text(text)
    rest = T.normalize_text(F.regexp_extract(t, NUMBERED_PART, 1))
    numbered = rest.rlike(r"^[.)]?\z") | rest.rlike(r"^[:\-\x{2013}\x{2014}]\s*\S") | emphasized
    return F.when(t.rlike(NUMBERED_PART), numbered).otherwise(t.rlike(ALONE) | (emphasized & (t.rlike(SET_APART) | t.rlike(NUMBERED_TITLE))))


def bare_heading(text: Column) -> Column:
    """Whether a text is a numbered part and nothing else."""
    return T.normalize_text(text).rlike(rf"(?i)^(?:chapter|book|part|section)\s+{_NUMBER}[.)]?\z")


def heading_kind(text: Column, x_min: Column, x_max: Column, font_size: Column, width: Column, body_size: Column) -> Column:
    """``strong``, ``typographic`` or null: a line of at most 180 characters and 20 words without leaders that says so, is in capitals, or is larger than the body and short or in the middle of the page."""
    words = T.count_words(text)
    larger = font_size >= body_size * 1.17
    centred = F.abs((x_min + x_max) / 2 - width / 2) <= width * 0.12
    letters = F.filter(F.split(text, ""), lambda c: c.rlike(r"^\p{L}\z"))
    capitals = F.size(F.filter(letters, lambda c: c == F.upper(c)))
    caps = (F.size(letters) >= 3) & (capitals / F.greatest(F.size(letters), F.lit(1)) >= 0.9) & (words <= 12)
    fit = (F.length(text) <= 180) & words.between(1, 20) & ~text.rlike(r"\.{3,}")
    return F.when(fit, F.when(explicit_heading(text, larger), "strong").when(caps | (larger & (centred | (words <= 10))), "typographic"))


def quality_diagnostics(paragraphs: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, bucket, code, severity, message) of printed books whose text cannot be read: too little of it, pages without, upright lines on their side, replaced characters.

    ``paragraphs``: book_id, text; ``pages``: book_id, page, has_text, images (declared), items, vertical_items; a book without pages is not judged.
    """
    odd = F.length(F.regexp_replace("text", r"[^\x{FFFD}\x{E000}-\x{F8FF}]", ""))
    texts = paragraphs.groupBy("book_id").agg(F.sum(T.count_words("text")).alias("words"), (F.sum(F.length(T.normalize_text("text")) + 1) - 1).alias("characters"), F.sum(odd).alias("odd"))
    seen = pages.groupBy("book_id").agg(F.count("*").alias("pages"), F.count_if("has_text").alias("text_pages"), F.count_if(F.col("images") > 0).alias("image_pages"), F.sum("items").alias("items"), F.sum("vertical_items").alias("vertical"))
    f = seen.join(texts, "book_id", "left").na.fill(0)
    few = (F.col("words") < 20) | (F.col("characters") < 80)
    sparse = ~few & (F.col("pages") >= 4) & (F.col("text_pages") / F.col("pages") < 0.25) & (F.col("words") / F.col("pages") < 20)
    scanned = F.col("image_pages") / F.col("pages") >= 0.5
    said = lambda cond, bucket, code, message: F.when(cond, F.struct(F.lit(bucket).alias("bucket"), F.lit(code).alias("code"), F.lit("failure").alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message")))
    text, other = "No / unusable text", "Other"
    every = F.array_compact(
        F.array(
            said(few, text, "unusable_text", F.when(scanned, "PDF appears to be scanned or image-only; OCR is out of scope for this phase").otherwise("PDF does not contain enough usable selectable text for a book import")),
            said(sparse, text, "picture_heavy", "Most PDF pages lack usable selectable text; the document likely requires OCR"),
            said((F.col("items") >= 20) & (F.col("vertical") / F.greatest(F.col("items"), F.lit(1)) >= 0.25), other, "other_failure", "Vertical or heavily rotated text cannot yet be reconstructed reliably"),
            said((F.col("odd") >= 10) & (F.col("odd") / F.greatest(F.col("characters"), F.lit(1)) > 0.02), text, "garbled_text", "Extracted PDF text contains too many replacement or private-use characters"),
        )
    )
    return f.select("book_id", F.explode(every).alias("d")).select("book_id", "d.*")


def merge_headings(paragraphs: DataFrame, gaps: DataFrame) -> DataFrame:
    """Neighbouring headings of a page as one, unless the second begins a heading of its own or stands apart.

    ``paragraphs``: drafts; ``gaps``: book_id, page, typical. Whether two belong together depends on them alone, so heading islands come from one window a page.
    """
    w = Window.partitionBy("book_id", "page").orderBy("para")
    last, first = F.element_at("lines", -1), F.get("lines", F.lit(0))
    at = paragraphs.join(gaps, ["book_id", "page"], "left").withColumns({"__last": F.lag(last).over(w), "__before": F.lag("heading").over(w)})
    near = (F.col("__last.col") == first["col"]) & (first["baseline"] - F.col("__last.baseline") <= F.col("typical") * 2.2 + 2)
    joins = F.col("__before").isNotNull() & F.col("heading").isNotNull() & near & ~F.col("text").rlike(OWN_HEADING)
    island = F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w)
    at = at.withColumn("__island", island)
    parts = F.array_sort(F.collect_list(F.struct("para", "text", "lines", "heading")))
    got = at.groupBy("book_id", "page", "__island").agg(parts.alias("p"))
    heading = F.when(F.exists("p", lambda x: x["heading"] == "strong"), "strong").otherwise(F.get("p", F.lit(0))["heading"])
    text = F.when(F.size("p") == 1, F.get("p", F.lit(0))["text"]).otherwise(joined(F.transform("p", lambda x: x["text"])))
    return got.select("book_id", "page", F.get("p", F.lit(0))["para"].alias("para"), heading.alias("heading"), text.alias("text"), F.flatten(F.transform("p", lambda x: x["lines"])).alias("lines"))


def continues(end: Column, begin: Column) -> Column:
    """Whether a text that begins a page carries on one that ends the page before; by its last and its first two characters."""
    hyphen = end.rlike(r"[-\x{2010}\x{2011}]\z")
    open_end = ~end.rlike(ENDS) & begin.rlike(r"^[\p{Ll}\x{201C}\x{2018}]")
    return F.when(hyphen, begin.rlike(r"^\p{Ll}")).otherwise(end.rlike(r"[,;:]\z") | open_end)


def merge_pages(paragraphs: DataFrame) -> DataFrame:
    """The first paragraph of a page joined to the last one before, where it carries that on; over any number of pages.

    Islands in two levels: inside pages nothing moves, and a window over one narrow row a page (the characters at its edges) finds
    which pages carry on. Only the paragraphs that merge are grouped.
    """
    edge = lambda f: f(F.struct("para", F.col("heading").isNull().alias("plain"), F.substring("text", 1, 2).alias("begin"), F.substring("text", -2, 2).alias("end")))
    pages = paragraphs.groupBy("book_id", "page").agg(edge(F.min).alias("first"), edge(F.max).alias("last"))
    w = Window.partitionBy("book_id").orderBy("page")
    before = F.lag("last").over(w)
    carries = F.coalesce(before["plain"] & F.col("first.plain") & continues(before["end"], F.col("first.begin")), F.lit(False))
    flagged = pages.withColumn("carries", carries)
    # where the last paragraph of each page begins: on this page, or where the pages that it carries on begin
    whole = F.col("carries") & (F.col("first.para") == F.col("last.para"))
    head = F.last(F.when(~whole, F.struct("page", F.col("last.para").alias("para"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    heads = flagged.withColumn("head", head)
    moved = heads.withColumn("to", F.lag("head").over(w)).where("carries").select("book_id", "page", F.col("first.para").alias("para"), "to")
    targets = moved.select("book_id", F.col("to.page").alias("page"), F.col("to.para").alias("para"), F.col("to")).distinct()
    at = paragraphs.join(moved.unionByName(targets), ["book_id", "page", "para"], "left")
    alone = at.where("to IS NULL").drop("to")
    parts = F.array_sort(F.collect_list(F.struct("page", "para", "heading", "text", "lines")))
    merged = at.where("to IS NOT NULL").groupBy("book_id", "to").agg(parts.alias("p"))
    merged = merged.select("book_id", F.col("to.page").alias("page"), F.col("to.para").alias("para"), F.get("p", F.lit(0))["heading"].alias("heading"), joined(F.transform("p", lambda x: x["text"])).alias("text"), F.flatten(F.transform("p", lambda x: x["lines"])).alias("lines"))
    return alone.unionByName(merged.select(alone.columns))


def ornament(c: Column) -> Column:
    """A line of ornaments only: one of the large ones, or three marks or more with nothing but separators between."""
    t = T.normalize_text(c)
    return ~T.col(c).rlike(r"[\p{L}\p{N}]") & (t.rlike(LONE) | ((F.regexp_count(t, F.lit(MARKS)) >= 3) & (F.regexp_replace(t, SEPARATORS, "") == "")))


def typical_gaps(lines: DataFrame) -> DataFrame:
    """(book_id, page, typical): the median step between lines of a column, steps of three font sizes and more left out. ``lines``: book_id, page, col, baseline, font_size."""
    w = Window.partitionBy("book_id", "page", "col").orderBy("baseline")
    gap = F.col("baseline") - F.lag("baseline").over(w)
    most = F.greatest("font_size", F.lag("font_size").over(w)) * 3
    return lines.withColumns({"gap": gap, "most": most}).where((F.col("gap") > 0) & (F.col("gap") < F.col("most"))).groupBy("book_id", "page").agg(F.median("gap").alias("typical"))


def scene_breaks(paragraphs: DataFrame) -> DataFrame:
    """Ornaments consumed, and the paragraph behind one (or behind a wide gap) marked: (book_id, id, part, text, lines, scene).

    ``paragraphs``: book_id, id (order), page, heading, text, lines. A paragraph is an ornament, has one as its first or last line or inside, or none. An ornament
    that ends the paragraph before, or is all of it, marks the next; so the state is in the row before and needs no fold. Gaps are held against the page's own typical gap. ``part``
    is 1 for what an ornament inside a paragraph splits off.
    """
    from leafmill.session import with_checkpoints

    with_checkpoints(paragraphs.sparkSession)
    texts = lambda lines: joined(F.transform(lines, lambda x: x["text"]))
    lines, n = F.col("lines"), F.size("lines")
    tail, front = F.slice("lines", F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice("lines", F.lit(1), F.greatest(n - 1, F.lit(0)))
    at = paragraphs.withColumns(
        {
            "alone": ornament(F.col("text")),
            "by_line": F.transform(lines, lambda x: ornament(x["text"])),
            "run": F.regexp_extract("text", rf"(?![!-)+-~])(?:\s*{MARKS}){{16,}}\s*", 0),
        }
    )
    inside = (F.array_position("by_line", True) - 1).cast("int")  # the first ornament line, from 0
    at = at.withColumns({"inside": inside, "tail": tail, "tail_text": texts(tail), "front": front, "front_text": texts(front)})
    at = at.withColumns({"above": F.slice("lines", F.lit(1), F.greatest("inside", F.lit(0))), "below": F.slice("lines", F.col("inside") + 2, F.greatest(n - F.col("inside") - 1, F.lit(0)))})
    at = at.withColumns({"above_text": texts(F.col("above")), "below_text": texts(F.col("below")), "run_at": F.when(F.col("run") != "", F.expr("locate(run, text)"))})
    at = at.withColumns({"run_above": T.normalize_text(F.substring("text", F.lit(1), F.col("run_at") - 1)), "run_below": T.normalize_text(F.substring("text", F.col("run_at") + F.length("run"), F.length("text")))})
    enough = lambda c: T.count_words(c) >= 3
    by_lines = (F.col("inside") > 0) & (F.col("inside") < n - 1) & enough("above_text") & enough("below_text")
    by_run = F.col("run_at").isNotNull() & enough("run_above") & enough("run_below") & F.col("run_above").rlike(ENDS) & F.col("run_below").rlike(BEGINS)
    # which places a paragraph has in its book, from narrow rows
    facts = at.select("book_id", "id", "alone").groupBy("book_id").agg(F.min(F.when(~F.col("alone"), F.col("id"))).alias("first_kept"), F.max("id").alias("last_id"))
    at = at.join(facts, "book_id")
    opened, more = F.col("id") > F.col("first_kept"), F.col("id") < F.col("last_id")
    kind = (
        F.when(F.col("alone"), "ornament")
        .when(F.get("by_line", F.lit(0)) & (n > 1) & opened & enough("tail_text"), "first")
        .when(F.element_at("by_line", -1) & (n > 1) & more & enough("front_text"), "last")
        .when(by_lines, "lines")
        .when(by_run, "run")
        .otherwise("plain")
    )
    # an empty array has neither a first nor a last line
    at = at.withColumn("kind", F.when(n > 0, kind).otherwise(F.when(F.col("alone"), "ornament").when(by_run, "run").otherwise("plain")))
    is_ = lambda k: F.col("kind") == k
    text = F.when(is_("first"), F.col("tail_text")).when(is_("last"), F.col("front_text")).when(is_("lines"), F.col("below_text")).when(is_("run"), F.col("run_below")).otherwise(F.col("text"))
    kept = F.when(is_("first"), F.col("tail")).when(is_("last"), F.col("front")).when(is_("lines"), F.col("below")).otherwise(lines)
    split = F.col("kind").isin("lines", "run")
    before = F.when(is_("lines"), F.col("above_text")).otherwise(F.col("run_above"))
    at = at.withColumns({"out_text": text, "out_lines": kept, "opened": opened, "before": F.when(split, F.struct(before.alias("text"), F.when(is_("lines"), F.col("above")).otherwise(lines).alias("lines")))})
    # what the next paragraph needs of this one: narrow
    end, begin = F.element_at("out_lines", -1), F.get("lines", F.lit(0))
    narrow = {
        "plain": F.col("heading").isNull(), "end_col": end["col"], "end_at": end["baseline"], "begin_col": begin["col"], "begin_at": begin["baseline"], "font": begin["font_size"],
        "closes": (T.count_words("out_text") >= 8) & F.substring("out_text", -1, 1).rlike(ENDS), "starts": (T.count_words("text") >= 8) & F.substring("text", 1, 1).rlike(BEGINS),
        "steps": F.transform("lines", lambda x: F.struct(x["col"].alias("col"), x["baseline"].alias("baseline"), x["font_size"].alias("font_size"))),
    }
    kept = ["book_id", "id", "page", "kind", "opened", "before", "out_text", "out_lines", *narrow]
    at = at.withColumns(narrow).select(kept).checkpoint()  # read three times; all that looks into texts is done
    narrow = at.drop("before", "out_text", "out_lines", "steps")
    w = Window.partitionBy("book_id").orderBy("id")
    previous = narrow.withColumn("p", F.lag(F.struct("kind", "opened", "plain", "page", "end_col", "end_at", "closes")).over(w))
    flat = at.select("book_id", "page", F.explode("steps").alias("l")).select("book_id", "page", "l.col", "l.baseline", "l.font_size")
    previous = previous.join(typical_gaps(flat), ["book_id", "page"], "left")
    gap = F.col("begin_at") - F.col("p.end_at")
    wide = gap >= F.greatest(F.col("typical") * 2.2, F.col("typical") + F.greatest(F.lit(8.0), F.col("font") * 0.75))
    # the page of the line before: a paragraph lies on the page where it begins
    space = F.col("plain") & F.col("p.plain") & (F.col("p.page") == F.col("page")) & (F.col("p.end_col") == F.col("begin_col")) & wide & F.col("p.closes") & F.col("starts") & (F.col("p.kind") != "ornament")
    pending = ((F.col("p.kind") == "ornament") & F.col("p.opened")) | (F.col("p.kind") == "last")
    flags = previous.select("book_id", "id", F.coalesce(pending, F.lit(False)).alias("pending"), F.coalesce(space, F.lit(False)).alias("space"))
    out = at.join(flags, ["book_id", "id"])
    marked = F.when(F.col("kind").isin("first", "lines", "run"), "text-ornament").when(is_("plain"), F.when(F.col("pending"), "text-ornament").when(F.col("space"), "whitespace"))
    split = F.col("before").isNotNull()
    part = lambda n, text, lines, scene: F.struct(n.alias("part"), text.alias("text"), lines.alias("lines"), scene.alias("scene"))
    second = part(F.when(split, 1).otherwise(0), F.col("out_text"), F.col("out_lines"), marked)
    first = part(F.lit(0), F.col("before.text"), F.col("before.lines"), F.lit(None).cast("string"))
    return out.where("kind <> 'ornament'").select("book_id", "id", F.explode(F.when(split, F.array(first, second)).otherwise(F.array(second))).alias("x")).select("book_id", "id", "x.*")


def image_anchors(images: DataFrame, lines: DataFrame) -> DataFrame:
    """(book_id, image_id, after_paragraph_id): the last paragraph with a line above an image's middle in its column, else the last of earlier pages, else 0.

    ``images``: book_id, page, image_id, x, y (the middle), width (of the page); ``lines``: book_id, page, paragraph_id, col, baseline, x_min, x_max. A line of column 0
    stands above all that is below it; others reach over their width and a tenth of the page at both sides. Images and lines go by book in one exchange, and each image is held against its
    book's lines there; books that are too large for that (``grouped.MOST_ROWS``) are judged by joins.
    """
    from leafmill.operators import grouped

    (im, ln), large = grouped.split_groups([(images, None), (lines, None)], ["book_id"])
    image, line = ["page", "image_id", "x", "y", "width"], ["page", "paragraph_id", "col", "baseline", "x_min", "x_max"]
    placed = im.where("book_id IS NOT NULL").select("book_id", F.struct(*image).alias("i"))
    both = placed.unionByName(ln.where("book_id IS NOT NULL").select("book_id", F.struct(*line).alias("l")), allowMissingColumns=True)
    books = both.repartition("book_id").groupBy("book_id").agg(F.collect_list("i").alias("images"), F.collect_list("l").alias("lines")).where(F.size("images") > 0)
    last = lambda cond: F.array_max(F.transform(F.filter("lines", cond), lambda m: m["paragraph_id"]))

    def anchor(i: Column, tenth: Column) -> Column:
        beside = lambda m: (i["x"] >= m["x_min"] - tenth) & (i["x"] <= m["x_max"] + tenth)
        above = last(lambda m: (m["page"] == i["page"]) & (m["baseline"] <= i["y"]) & ((m["col"] == 0) | beside(m)))
        return F.struct(i["image_id"].alias("image_id"), F.coalesce(above, last(lambda m: m["page"] < i["page"]), F.lit(0)).cast("long").alias("after_paragraph_id"))

    width = lambda i: F.array_max(F.transform(F.filter("images", lambda o: o["page"] == i["page"]), lambda o: o["width"]))
    got = books.select("book_id", F.explode(F.transform("images", lambda i: F.get(F.transform(F.array(width(i) * 0.1), lambda tenth: anchor(i, tenth)), F.lit(0)))).alias("a")).select("book_id", "a.*")
    unknown = im.where("book_id IS NULL").select("book_id", "image_id", F.lit(0).cast("long").alias("after_paragraph_id"))
    got = got.unionByName(unknown)
    return got if large is None else got.unionByName(image_anchors_by_joins(*large))


def image_anchors_by_joins(images: DataFrame, lines: DataFrame, bins: int = 40) -> DataFrame:
    """``image_anchors`` for books of any size. The page is cut into upright lanes: a line that covers a lane whole is filled downwards there by a running maximum; where it ends inside a lane, the
    images of that lane are compared one by one. Earlier pages are a running maximum over a row a page.
    """
    page = ["book_id", "page"]
    widths = images.groupBy(*page).agg(F.max("width").alias("width"))
    lane = lambda x: F.floor(x * bins / F.col("width")).cast("int")
    placed = images.withColumn("lane", lane(F.col("x")))
    # lines of pages that hold images only
    at = lines.join(widths.hint("merge"), page).withColumns({"left": F.col("x_min") - F.col("width") * 0.1, "right": F.col("x_max") + F.col("width") * 0.1})
    at = at.withColumns({"first": lane(F.col("left")), "last": lane(F.col("right"))})
    whole = at.where("col = 0").select(*page, "paragraph_id", F.col("baseline").alias("y"), F.lit(None).cast("int").alias("lane"))
    spans = at.where("col <> 0 AND last - first >= 2").select(*page, "paragraph_id", F.col("baseline").alias("y"), F.explode(F.sequence(F.col("first") + 1, F.col("last") - 1)).alias("lane"))
    asks = placed.select(*page, "image_id", "y", F.explode(F.array(F.col("lane"), F.lit(None).cast("int"))).alias("lane"))
    none = F.lit(None)
    both = whole.unionByName(spans).withColumn("image_id", none.cast("long")).unionByName(asks.withColumn("paragraph_id", none.cast("long")))
    w = Window.partitionBy(*page, "lane").orderBy("y", F.col("image_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("above", F.max("paragraph_id").over(w)).where("image_id IS NOT NULL").select("book_id", "image_id", "above")
    edges = at.where("col <> 0").select(*page, "paragraph_id", "baseline", "left", "right", F.explode(F.array_distinct(F.array("first", "last"))).alias("lane"))
    beside = placed.join(edges.hint("merge"), [*page, "lane"]).where("baseline <= y AND x >= left AND x <= right").select("book_id", "image_id", F.col("paragraph_id").alias("above"))
    found = filled.unionByName(beside).groupBy("book_id", "image_id").agg(F.max("above").alias("above"))
    pages = lines.groupBy(*page).agg(F.max("paragraph_id").alias("most")).unionByName(widths.select(*page, none.cast("long").alias("most"))).groupBy(*page).agg(F.max("most").alias("most"))
    earlier = F.max("most").over(Window.partitionBy("book_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    before = pages.select(*page, earlier.alias("earlier"))
    at_last = images.select(*page, "image_id").join(found.hint("merge"), ["book_id", "image_id"], "left").join(before.hint("merge"), page, "left")
    return at_last.select("book_id", "image_id", F.coalesce("above", "earlier", F.lit(0)).cast("long").alias("after_paragraph_id"))


def recurring_edge_images(images: DataFrame) -> DataFrame:
    """(book_id, object_id) of images that lie in the outer 15 % of three pages or more. ``images``: book_id, page, object_id, y_min, y_max, height."""
    edge = (F.col("y_max") <= F.col("height") * 0.15) | (F.col("y_min") >= F.col("height") * 0.85)
    return images.where(edge).groupBy("book_id", "object_id").agg(F.count_distinct("page").alias("pages")).where("pages >= 3").select("book_id", "object_id")


#: What marks a chapter inside prose; the longest marker and what may follow it.
MARKER = rf"(?i)(?<![A-Za-z0-9_])chapter\s+(?:\p{{N}}{{1,3}}|[ivxlcdm]{{1,8}}|{'|'.join(T.NUMBER_WORDS)})(?:[.)]|(?![A-Za-z0-9_]))"
_LOOK = 12


def paragraph_begins(paragraphs: DataFrame) -> DataFrame:
    """(book_id, para, begin): the place of each paragraph's first character in its book, by running sums in blocks."""
    from leafmill.operators.prefix import running_sum

    sized = paragraphs.select("book_id", "para", (F.length("text") + 1).cast("long").alias("size"))
    return running_sum(sized, "book_id", "para", [], F.col("size"), "upto").select("book_id", "para", (F.col("upto") - F.col("size")).alias("begin"))


def chapter_markers(paragraphs: DataFrame, begins: DataFrame | None = None) -> DataFrame:
    """(book_id, para, heading, offset, end, ord): the places where a text says "chapter" and a number, from the book's first character on.

    ``paragraphs``: book_id, para (from 1), heading, text; texts are joined by one line end, over which a marker may reach. ``begins``: as ``paragraph_begins`` gives them.
    """
    offsets = paragraph_begins(paragraphs) if begins is None else begins
    said = paragraphs.where(F.lower("text").contains("chapter")).select("book_id", "para", "heading", "text", F.length("text").alias("n"))
    # a text's own markers; only places and words leave its row
    between = F.transform(F.split("text", MARKER, -1), F.length)
    each = said.select("book_id", "para", "heading", F.arrays_zip(F.regexp_extract_all("text", F.lit(MARKER), F.lit(0)).alias("s"), between.alias("skip")).alias("m"))
    each = each.select("book_id", "para", "heading", F.posexplode("m").alias("k", "m")).select("book_id", "para", "heading", "k", "m.s", "m.skip").where("s IS NOT NULL")
    ahead = F.sum(F.col("skip") + F.length("s")).over(Window.partitionBy("book_id", "para").orderBy("k")) - F.length("s")
    own = each.withColumn("local", ahead).select("book_id", "para", "heading", "s", "local")
    # a text that ends with the word: the number may be the head of the next paragraph
    tail = F.regexp_extract("text", r"(?i)(?<![A-Za-z0-9_])chapter\s*\z", 0)
    open_ = said.select("book_id", "para", "heading", "n", tail.alias("tail")).where("tail <> ''")
    heads = paragraphs.select("book_id", (F.col("para") - 1).alias("para"), F.substring("text", 1, _LOOK).alias("head"))
    seam = open_.join(heads, ["book_id", "para"]).withColumn("s", F.regexp_extract(F.concat("tail", F.lit("\n"), "head"), rf"\A{MARKER}", 0)).where("s <> ''")
    seam = seam.select("book_id", "para", "heading", "s", (F.col("n") - F.length("tail")).cast("long").alias("local"))
    local = own.unionByName(seam).join(offsets, ["book_id", "para"])
    token = F.regexp_replace(F.regexp_replace(F.lower("s"), r"^chapter\s+", ""), r"[.)]\z", "")
    return local.select("book_id", "para", "heading", (F.col("begin") + F.col("local")).alias("offset"), (F.col("begin") + F.col("local") + F.length("s")).alias("end"), T.ordinal_parse(token).alias("ord")).where("ord IS NOT NULL")


def chapter_sequences(markers: DataFrame) -> DataFrame:
    """(book_id, seq, n, first, last, run): the runs 1, 2, 3, ... from each marker 1 to the next one, markers out of turn left out.

    ``markers``: book_id, offset, ord and others. The markers between two ones are a segment; in it a greedy fold takes each number as it comes.
    """
    one = F.sum((F.col("ord") == 1).cast("int")).over(Window.partitionBy("book_id").orderBy("offset"))
    parts = F.array_sort(F.collect_list(F.struct("offset", "end", "ord", "para", "heading")))
    segments = markers.withColumn("seq", one).where("seq > 0").groupBy("book_id", "seq").agg(parts.alias("m"))
    take = lambda run, m: F.when(m["ord"] == F.size(run) + 1, F.concat(run, F.array(m))).otherwise(run)
    run = F.aggregate("m", F.slice("m", 1, 0), take)
    return segments.select("book_id", "seq", run.alias("run")).select("book_id", "seq", F.size("run").alias("n"), F.get("run", F.lit(0))["offset"].alias("first"), F.element_at("run", -1)["offset"].alias("last"), "run")


def body_and_contents(sequences: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(body, contents): of each book the run that its chapters follow, and a compact one before it that is as long, if there is one.

    A body has three markers or more, each in a paragraph of its own without a heading, over a fifth of the text and 500 characters; the longest, then the widest, then the first is taken. Contents span
    at most 1,500 characters or a twentieth. ``lengths``: book_id, length.
    """
    at = sequences.join(lengths, "book_id").withColumn("span", F.col("last") - F.col("first"))
    own = (F.size(F.array_distinct(F.transform("run", lambda m: m["para"]))) == F.col("n")) & F.forall("run", lambda m: m["heading"].isNull())
    good = (F.col("n") >= 3) & own & (F.col("span") >= F.greatest(F.lit(500.0), F.col("length") * 0.2))
    pick = lambda order: F.max_by(F.struct("seq", "n", "first", "last", "run"), order)
    body = at.where(good).groupBy("book_id").agg(pick(F.struct("n", "span", (-F.col("seq")).alias("s"))).alias("b")).select("book_id", "b.*")
    b = body.select("book_id", F.col("seq").alias("of"), F.col("n").alias("least"), F.col("first").alias("begin"))
    other = at.join(b, "book_id").where((F.col("seq") != F.col("of")) & (F.col("n") >= F.col("least")) & (F.col("last") < F.col("begin")) & (F.col("span") <= F.greatest(F.lit(1500.0), F.col("length") * 0.05)))
    contents = other.groupBy("book_id").agg(pick(F.struct((-F.col("span")).alias("w"), (-F.col("seq")).alias("s"))).alias("b")).select("book_id", "b.*")
    return body, contents


def contents_titles(contents: DataFrame, markers: DataFrame, body: DataFrame, paragraphs: DataFrame, begins: DataFrame) -> DataFrame:
    """(book_id, ord, title): what stands behind each marker of the contents, up to the next marker, as the chapter's full title.

    At most 160 characters, 16 words and one sentence; ``begins``: book_id, para, begin. The text behind a marker comes from its paragraph and the two behind it.
    """
    m = contents.select("book_id", F.posexplode("run").alias("k", "m"), "run").select("book_id", "m.*", F.get("run", F.col("k") + 1)["offset"].alias("next"))
    ahead = markers.select("book_id", "offset", F.lead("offset").over(Window.partitionBy("book_id").orderBy("offset")).alias("any_next"))
    stop = F.least(F.coalesce("next", "any_next", "begin_body"), F.col("end") + 160)
    m = m.join(ahead, ["book_id", "offset"]).join(body.select("book_id", F.col("first").alias("begin_body")), "book_id").withColumn("stop", stop)
    m = m.join(begins, ["book_id", "para"]).groupBy("book_id", "para").agg(F.collect_list(F.struct("ord", "offset", "end", "stop", "begin")).alias("info"))
    near = _with_info(paragraphs, m, ahead=2).withColumn("head", F.substring("text", 1, 200))
    behind = lambda d: F.when(F.lead("para", d).over(_in_block()) == F.col("para") + d, F.lead("head", d).over(_in_block()))
    near = near.withColumns({"t1": behind(1), "t2": behind(2)}).where("own AND info IS NOT NULL")
    m = near.select("book_id", F.col("text").alias("t0"), "t1", "t2", F.explode("info").alias("m")).select("book_id", "t0", "t1", "t2", "m.*")
    full = F.concat_ws("\n", "t0", "t1", "t2")
    cut = lambda a, b: T.normalize_text(F.substring(full, (a - F.col("begin") + 1).cast("int"), (b - a).cast("int")))
    m = m.withColumns({"suffix": cut(F.col("end"), F.col("stop")), "label": cut(F.col("offset"), F.col("end"))})
    good = (F.length("suffix") > 0) & (T.count_words("suffix") <= 16) & ~F.col("suffix").rlike(r"[.!?]\s+\p{Lu}")
    return m.where(good).select("book_id", "ord", F.trim(F.concat("label", F.lit(" "), "suffix")).alias("title"))


def embedded_headings(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with the chapter headings that stand inside prose as rows of their own: (book_id, para, piece, heading, text).

    ``paragraphs``: book_id, para (from 1 without gaps), heading, text (normalised). Where a body run is found, the paragraph at each of its markers becomes up to three: what is before (without ornaments at its end),
    the heading with the title that the contents give where the text has it, and what follows; paragraphs of the contents keep what is before the word. Other books stay as they are.
    """
    from leafmill.session import with_checkpoints

    with_checkpoints(paragraphs.sparkSession)
    paragraphs = paragraphs.select("book_id", "para", "heading", "text").checkpoint()  # read by every step
    begins = paragraph_begins(paragraphs).checkpoint()
    markers = chapter_markers(paragraphs, begins).checkpoint()  # narrow, and read four times
    lengths = paragraphs.select("book_id", (F.length("text") + 1).cast("long").alias("size")).groupBy("book_id").agg((F.sum("size") - 1).alias("length"), F.count("*").alias("paras")).where("paras >= 3")
    body, contents = [df.checkpoint() for df in body_and_contents(chapter_sequences(markers), lengths)]
    titles = contents_titles(contents, markers, body, paragraphs, begins)
    ranges = body.select("book_id", F.explode("run").alias("m")).select("book_id", "m.para", "m.offset", "m.end", "m.ord").join(titles, ["book_id", "ord"], "left")
    listed = contents.select("book_id", F.explode("run").alias("m")).select("book_id", F.col("m.para").alias("para")).distinct().withColumn("listed", F.lit(True))
    # texts are exchanged once, each beside what is known of its place and the next one, in which a heading may end
    at = ranges.join(begins, ["book_id", "para"]).select("book_id", "para", F.struct((F.col("offset") - F.col("begin")).cast("int").alias("local"), (F.col("end") - F.col("offset")).cast("int").alias("long"), "title").alias("r"))
    known = at.unionByName(listed, allowMissingColumns=True).groupBy("book_id", "para").agg(F.first("r", ignorenulls=True).alias("r"), F.max("listed").alias("listed")).select("book_id", "para", F.struct("r", "listed").alias("info"))
    hit = _with_info(paragraphs, known, ahead=1, behind=1)
    hit = hit.withColumn("next", F.when(F.lead("para").over(_in_block()) == F.col("para") + 1, F.lead("text").over(_in_block()))).select("book_id", "block", "own", "para", "heading", "text", "next", "info.r.local", "info.r.long", "info.r.title", F.coalesce("info.listed", F.lit(False)).alias("listed"))
    full = F.concat_ws("\n", "text", "next")
    words = F.concat(F.lit(r"(?i)^\Q"), F.array_join(F.split(F.replace("title", F.lit("\\E"), F.lit(" ")), " "), r"\E\s+\Q"), F.lit(r"\E"))
    behind = F.substring(full, F.col("local") + 1, F.length(full))
    hit = hit.withColumns({"behind": behind, "words": words})
    by_title = F.when(F.col("title").isNotNull(), F.length(F.expr("regexp_extract(behind, words, 0)"))).otherwise(0)  # a pattern of each row's own
    hit = hit.withColumn("taken", F.when(by_title > 0, by_title).otherwise(F.col("long"))).withColumns({"full": full, "n": F.length("text")})
    stop = F.col("local") + F.col("taken")
    prefix = F.trim(F.regexp_replace(T.normalize_text(F.substring("text", F.lit(1), F.col("local"))), r"(?:\s*\*){3,}\s*\z", ""))
    suffix = T.normalize_text(F.substring("full", stop + 1, F.length("full")))
    own_suffix = F.when(stop > F.col("n") + 1, suffix).otherwise(T.normalize_text(F.substring("text", stop + 1, F.length("text"))))
    pieces = F.array(F.struct(F.lit(0).alias("piece"), F.col("heading").alias("heading"), prefix.alias("text")), F.struct(F.lit(1).alias("piece"), F.lit("strong").alias("heading"), T.normalize_text(F.substring("full", F.col("local") + 1, F.col("taken"))).alias("text")), F.struct(F.lit(2).alias("piece"), F.col("heading").alias("heading"), own_suffix.alias("text")))
    word = F.regexp_instr("text", F.lit(r"(?i)(?<![A-Za-z0-9_])contents(?![A-Za-z0-9_])"))
    kept = F.when(F.col("listed"), F.when(word > 0, T.normalize_text(F.substring("text", F.lit(1), word - 1))).otherwise(F.lit(""))).otherwise(F.col("text"))
    rest = F.array(F.struct(F.lit(0).alias("piece"), F.col("heading").alias("heading"), kept.alias("text")))
    hit = hit.withColumn("over", F.coalesce(stop > F.col("n") + 1, F.lit(False)))
    # what a heading has taken of the next paragraph is not there twice
    gone = F.coalesce(F.lag("over").over(_in_block()) & (F.lag("para").over(_in_block()) == F.col("para") - 1), F.lit(False))
    out = hit.withColumn("gone", gone).where("own AND (local IS NOT NULL OR NOT gone)")
    return out.select("book_id", "para", F.explode(F.when(F.col("local").isNotNull(), pieces).otherwise(rest)).alias("x")).select("book_id", "para", "x.piece", "x.heading", "x.text").where("text <> ''")


#: Paragraphs of a book that one task looks at together; those at the edges are in two blocks.
_BLOCK = 256


def _in_block():
    return Window.partitionBy("book_id", "block").orderBy("para")


def _with_info(paragraphs: DataFrame, info: DataFrame, ahead: int, behind: int = 0) -> DataFrame:
    """Paragraphs with ``block``, ``own`` and what ``info`` (book_id, para, info; one row a place) says of their place, if it does; one exchange, by blocks of a book.

    A block has its own paragraphs, ``ahead`` of the next block's and ``behind`` of the last one's, so that windows over it see what is beside each of its own.
    """
    block, at = F.floor(F.col("para") / _BLOCK), F.pmod(F.col("para"), F.lit(_BLOCK))
    blocks = F.array_compact(F.array(block, F.when(at < ahead, block - 1), F.when(at >= _BLOCK - behind, block + 1)))
    rows = paragraphs.select("book_id", "para", F.lit(1).alias("kind"), "heading", "text").unionByName(info.select("book_id", "para", F.lit(0).alias("kind"), "info"), allowMissingColumns=True)
    rows = rows.withColumn("block", F.explode(blocks)).withColumn("own", F.col("block") == block)
    before = Window.partitionBy("book_id", "block").orderBy("para", "kind").rowsBetween(Window.unboundedPreceding, 0)
    said = F.last(F.when(F.col("kind") == 0, F.struct("para", "info")), ignorenulls=True).over(before)
    return rows.withColumn("said", said).where("kind = 1").select("book_id", "block", "own", "para", "heading", "text", F.when(F.col("said.para") == F.col("para"), F.col("said.info")).alias("info"))


def outline_starts(outline: DataFrame, headings: DataFrame, lines: DataFrame) -> DataFrame:
    """(book_id, ord, title, start, matched): the paragraph that each item of an outline points to.

    A heading of the page with the item's title (the same key, or four fifths of the words); else the paragraph whose line lies nearest to the target, the earlier one of equals;
    else, without a target, the page's first. Items of pages without text are left out. ``outline``: book_id, ord, title, page, y; ``headings``: book_id, page, paragraph_id, title;
    ``lines``: book_id, page, paragraph_id, baseline. All three go by page in one exchange, to the task that holds the page; pages too large for that
    (``grouped.MOST_ROWS``) are judged by joins.
    """
    from leafmill.operators import grouped

    page = ["book_id", "page"]
    (o, h, ln), large = grouped.split_groups([(outline, "title"), (headings, "title"), (lines, None)], page)
    rows = [
        o.select(*page, F.lit(0).alias("part"), F.col("ord").cast("long").alias("ord"), F.lit(None).alias("paragraph_id"), "title", F.col("y").cast("double").alias("y")),
        h.select(*page, F.lit(1).alias("part"), "paragraph_id", "title"),
        ln.select(*page, F.lit(2).alias("part"), "paragraph_id", F.col("baseline").cast("double").alias("y")),
    ]
    kind = StructType([StructField(name, t) for name, t in (("book_id", outline.schema["book_id"].dataType), ("ord", LongType()), ("title", StringType()), ("start", lines.schema["paragraph_id"].dataType), ("matched", BooleanType()))])
    both = rows[0].unionByName(rows[1], allowMissingColumns=True).unionByName(rows[2], allowMissingColumns=True)
    got = grouped.map_groups(both, page, kind, _starts_of_page)
    return got if large is None else got.unionByName(outline_starts_by_joins(*large))


def _starts_of_page(at: tuple, rows: list[tuple]) -> list[tuple]:
    """``outline_starts`` of one page. ``rows``: (part, ord, paragraph_id, title, y), part 0 of items, 1 of headings, 2 of lines."""
    from leafmill.operators.grouped import Titles

    lines = [(y, i) for part, _, i, _, y in rows if part == 2]
    if not lines or None in at:
        return []
    titles = Titles((i, title_key_of(title)) for part, _, i, title, _ in rows if part == 1)
    first = min((i for _, i in lines if i is not None), default=None)
    rungs: dict[float, object] = {}
    for y, i in lines:
        if y is not None and i is not None:
            rungs[y] = min(i, rungs.get(y, i))
    heights = sorted(rungs)

    def near(y: float):
        k = bisect.bisect_right(heights, y)
        sides = [(abs(v - y), rungs[v]) for v in heights[max(0, k - 1) : k + 1]]
        return min(sides)[1] if sides else first

    out = []
    for part, n, _, title, y in rows:
        if part == 0:
            hit = titles.look(title_key_of(title))
            out.append((at[0], n, title, hit if hit is not None else first if y is None else near(y), hit is not None))
    return out


def outline_starts_by_joins(outline: DataFrame, headings: DataFrame, lines: DataFrame) -> DataFrame:
    """``outline_starts`` for pages of any size. The nearest line is looked up from both sides: lines and targets in one order, filled from above and from below."""
    page = ["book_id", "page"]
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    from leafmill.session import with_checkpoints

    with_checkpoints(outline.sparkSession)
    o = outline.select(*page, "ord", title_key("title").alias("okey"))
    h = headings.select(*page, "paragraph_id", title_key("title").alias("hkey")).groupBy(*page, F.col("hkey").alias("okey")).agg(F.min("paragraph_id").alias("by_key")).checkpoint()
    keyed = o.join(h, [*page, "okey"], "left").checkpoint()
    rest = keyed.where("by_key IS NULL").select(*page, "okey").distinct()
    like = alike(rest.withColumn("otok", words("okey")), h.select(*page, F.col("by_key").alias("paragraph_id"), words("okey").alias("htok")), page, "otok", "htok")
    like = like.groupBy(*page, "okey").agg(F.min_by("paragraph_id", F.struct((-F.col("score")).alias("s"), "paragraph_id")).alias("by_words"))
    same = keyed.join(like, [*page, "okey"], "left").select("book_id", "ord", "by_key", "by_words")
    first = lines.groupBy(*page).agg(F.min("paragraph_id").alias("page_first"))
    rungs = lines.groupBy(*page, F.col("baseline").alias("y")).agg(F.min("paragraph_id").alias("paragraph_id"))
    none = F.lit(None)
    both = rungs.withColumn("ord", none.cast("long")).unionByName(outline.where("y IS NOT NULL").select(*page, "y", none.cast("long").alias("paragraph_id"), F.col("ord").cast("long").alias("ord")))
    w = Window.partitionBy(*page).orderBy("y", F.col("ord").isNotNull())
    rung = F.when(F.col("ord").isNull(), F.struct("y", "paragraph_id"))
    above, below = F.last(rung, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(rung, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    sided = both.withColumns({"above": above, "below": below}).where("ord IS NOT NULL")
    up, down = F.col("y") - F.col("above.y"), F.col("below.y") - F.col("y")
    nearest = F.when(F.col("below").isNull() | (up < down), F.col("above.paragraph_id")).when(F.col("above").isNull() | (down < up), F.col("below.paragraph_id")).otherwise(F.least("above.paragraph_id", "below.paragraph_id"))
    near = sided.select("book_id", "ord", nearest.alias("near"))
    at = outline.withColumn("ord", F.col("ord").cast("long")).join(same, ["book_id", "ord"]).join(near, ["book_id", "ord"], "left").join(first, page)
    matched = F.coalesce("by_key", "by_words")
    return at.select("book_id", "ord", "title", F.coalesce(matched, F.when(F.col("y").isNotNull(), F.col("near")), F.col("page_first")).alias("start"), matched.isNotNull().alias("matched"))


#: Titles that typesetting leaves behind, and headings of front and back matter.
ARTIFACT = r"\.pdf\z|(?<![a-z0-9_])(?:cover\s+(?:front|back)|bookblock|book\s*block|interior|blank[-\s]|txt\z)|^(?:front|back)(?:\.pdf)?\z"
MATTER = r"(?i)^(?:contents|preface|foreword|acknowledge?ments?|prologue|epilogue|afterword|appendix)(?![A-Za-z0-9_])"


def choose_chapters(books: DataFrame, outline: DataFrame, headings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chapters, diagnostics) of PDF books: the outline, or visible headings where it cannot be relied on, or one chapter.

    ``books``: book_id, title, paragraphs, pages, items (of the outline as it was read); ``outline``: book_id, ord, title, start, matched; ``headings``: book_id, title, start, prominence, strong, without copies of
    a table of contents (``heading_dedup``). All three go by book in one exchange and one order, by start, in which all judgements are running values and sums: a task holds one sort of its rows. Equal
    starts or numbers stand side by side there, so distinct ones are counted where they change. A book with several rows is judged for each, as joins would have it.
    """
    from leafmill.operators.geometry import structural_marker

    family, order = structural_marker("title")
    matter = F.coalesce(T.normalize_text("title").rlike(MATTER), F.lit(False))
    h = headings.where("book_id IS NOT NULL").withColumns({"family": family, "order": order, "matter": matter, "prominent": F.coalesce(F.col("prominence") >= 1.15, F.lit(False))})
    h = h.withColumn("marked", F.col("family").isNotNull() | F.col("matter"))
    rows = [
        books.select("book_id", F.lit(0).alias("part"), "title", F.lit(1).alias("start"), "paragraphs", "pages", "items"),
        outline.where("book_id IS NOT NULL").select("book_id", F.lit(1).alias("part"), "title", "start", "matched", F.lower(T.normalize_text("title")).rlike(ARTIFACT).alias("artifact")),
        h.select("book_id", F.lit(2).alias("part"), "title", "start", "strong", F.when(F.col("family") == "chapter", F.col("order")).alias("number"), "marked", "prominent", F.nullif(title_key(F.when(F.col("marked") | F.col("prominent"), F.col("title"))), F.lit("")).alias("key")),
    ]
    at = rows[0].unionByName(rows[1], allowMissingColumns=True).unionByName(rows[2], allowMissingColumns=True)
    in_order = Window.partitionBy("book_id").orderBy("part", "start", "number")
    every, before = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), in_order.rowsBetween(Window.unboundedPreceding, -1)
    part = F.col("part")
    which = lambda cond, c: F.when(cond, F.col(c))
    wide = lambda low, high: F.coalesce(high - low >= F.greatest(F.lit(20.0), F.col("paragraphs") * 0.2), F.lit(False))
    at = at.withColumn("n_strong", F.count_if("strong").over(every))
    # numbered chapters among strong headings, where there are two of these, else among all
    at = at.withColumn("turn", which((F.col("n_strong") < 2) | F.col("strong"), "number"))
    turn, last = F.col("turn"), F.col("last_turn")
    at = at.withColumn("last_turn", F.last("turn", ignorenulls=True).over(before))
    rises, falls = F.count_if(turn.isNotNull() & (last.isNull() | (turn > last))).over(every), F.count_if(turn < last).over(every)
    at = at.withColumns({"rises": rises, "falls": falls, "r_low": F.min(which(turn.isNotNull(), "start")).over(every), "r_high": F.max(which(turn.isNotNull(), "start")).over(every)})
    at = at.withColumn("numbered", (F.col("rises") >= 3) & (F.col("falls") == 0) & wide(F.col("r_low"), F.col("r_high")))
    # beside a reliable numbering only marked headings and matter are chapters; a heading counts for each row of its book
    at = at.withColumns({"n_books": F.count_if(part == 0).over(every), "n_loose": F.count_if((part == 0) & ~F.col("numbered")).over(every)})
    at = at.withColumn("times", F.when(F.col("marked"), F.col("n_books")).when(F.col("prominent"), F.col("n_loose")).otherwise(0))
    listed, kept = part == 1, F.col("times") > 0
    at = at.withColumn("last_start", F.last(F.when(listed | kept, F.struct("part", "start")), ignorenulls=True).over(before))
    new = F.col("start").isNotNull() & ~F.coalesce((F.col("last_start.part") == part) & (F.col("last_start.start") == F.col("start")), F.lit(False))
    sums = {"o_n": F.count_if(listed), "o_matched": F.count_if("matched"), "o_artifacts": F.count_if("artifact"), "o_starts": F.count_if(listed & new), "k_n": F.sum("times"), "k_starts": F.count_if(kept & new)}
    ends = {f"{x}_{n}": f(which(rows, c)) for x, rows, c in (("o", listed, "start"), ("k", kept, "start"), ("key", kept, "key")) for n, f in (("low", F.min), ("high", F.max))}
    at = at.withColumns({name: c.over(every) for name, c in {**sums, **ends}.items()})
    # three titles differ where one stands between the first and the last
    between = kept & (F.col("key") > F.col("key_low")) & (F.col("key") < F.col("key_high"))
    at = at.withColumn("k_differ", F.count_if(between).over(every) > 0)
    produced = (F.col("o_n") > 0) & (F.col("o_artifacts") >= F.col("o_n") / 2)
    trusted = (F.col("o_matched") >= 2) | ((F.col("o_n") >= 3) & ~produced & (F.col("o_starts") / F.greatest(F.col("o_n"), F.lit(1)) >= 0.6) & wide(F.col("o_low"), F.col("o_high")))
    fallback = F.col("numbered") | ((F.col("k_n") >= 3) & F.col("k_differ") & (F.col("k_starts") / F.greatest(F.col("k_n"), F.lit(1)) >= 0.75) & wide(F.col("k_low"), F.col("k_high")))
    replaced = (F.col("o_n") > 0) & ~trusted & (F.col("numbered") | (produced & fallback))
    source = F.when((F.col("o_n") > 0) & ~F.col("replaced"), "outline").when(F.col("k_n") > 0, "headings").when(F.col("paragraphs") > 0, "single").otherwise("none")
    at = at.withColumn("replaced", replaced).withColumn("source", source)
    of = lambda name: F.count_if((part == 0) & (F.col("source") == name)).over(every)
    n = F.when(part == 0, (F.col("source") == "single").cast("long")).when(listed, of("outline")).otherwise(F.col("times") * of("headings"))
    chapters = at.withColumn("n", n).where("book_id IS NOT NULL AND n > 0").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    chapters = chapters.select("book_id", F.when(part == 0, "single").when(listed, "outline").otherwise("headings").alias("source"), "title", F.col("start").cast("long").alias("start"))
    f = at.where(part == 0).withColumn("chosen", F.when(F.col("source") == "outline", F.col("o_n")).when(F.col("source") == "headings", F.col("k_n")).when(F.col("source") == "single", 1).otherwise(0))
    few = (F.col("items") > 0) & (F.col("o_n") / F.greatest(F.col("items"), F.lit(1)) < 0.4)
    said = lambda cond, severity, message: F.when(cond, F.struct(severity.alias("severity"), message.alias("message")))
    every = F.array_compact(
        F.array(
            said(F.col("replaced"), F.lit("warning"), F.lit("Weak PDF outline was replaced by a reliable visible-heading sequence")),
            said(few, F.when(F.col("k_n") > 0, "warning").otherwise("failure"), F.concat(F.lit("Only "), F.col("o_n").cast("string"), F.lit(" of "), F.col("items").cast("string"), F.lit(" PDF outline destinations could be mapped to text"))),
            said(F.col("source") == "single", F.lit("failure"), F.lit("PDF has no trustworthy outline or visible chapter headings")),
            said((F.col("paragraphs") > 0) & (F.col("pages") >= 12) & (F.col("chosen") < 2), F.lit("failure"), F.lit("Long PDF has no usable outline and too few reliable heading fallbacks")),
        )
    )
    diagnostics = f.select("book_id", F.explode(every).alias("d")).select("book_id", "d.*")
    return chapters, diagnostics
