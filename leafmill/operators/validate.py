"""Validation of the model: one row for each rule that fires, then hard and soft classification.

Per-book facts come from array expressions over the book's own row, so validating texts needs no shuffle; tables that lie apart
(chapters, images) are aggregated by book first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill import schemas as S
from leafmill.functions import text as T
from leafmill.operators.model import collapsed, paragraph_array

TEXT, IDS, CHAPTERS, IMAGES, COVER, TIME, OTHER = S.BUCKETS[0], S.BUCKETS[4], S.BUCKETS[1], S.BUCKETS[2], S.BUCKETS[3], S.BUCKETS[5], S.BUCKETS[7]


def diagnostic(fires: Column, bucket: str, severity: str | Column, code: str, message: Column) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(F.coalesce(fires, F.lit(False)), F.struct(F.lit(bucket).alias("bucket"), level.alias("severity"), F.lit(code).alias("code"), message.alias("message")))


def say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def text_facts(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Facts about a book's paragraphs: words, letters, characters, bad characters, the largest paragraph, ornaments."""
    own = documents.select(key, paragraph_array("text").alias("paras"))
    own = own.withColumns({"counts": F.transform("paras", T.count_words), "joined": F.array_join("paras", "\n")})
    return own.select(
        key,
        F.size("paras").alias("paragraphs"),
        F.aggregate("counts", F.lit(0), lambda a, x: a + x).alias("words"),
        T.letters("joined").alias("letters"),
        F.length("joined").alias("chars"),
        F.regexp_count("joined", F.lit(r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F]")).alias("bad_chars"),
        F.coalesce(F.array_max("counts"), F.lit(0)).alias("largest"),
        F.size(F.filter("paras", T.raw_ornament)).alias("ornaments"),
    )


def text_diagnostics(facts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, bucket, severity, code, message) of the rules over texts; more than 50,000 paragraphs stop all other rules."""
    f = {c: F.col(c) for c in ("paragraphs", "words", "letters", "chars", "bad_chars", "largest", "ornaments")}
    many = f["paragraphs"] > S.MAX_PARAGRAPHS
    heavy = (f["ornaments"] >= 20) & (f["ornaments"] / F.greatest(f["paragraphs"], F.lit(1)) > 0.02)
    plural = F.when(f["ornaments"] == 1, "").otherwise("s")
    rules = F.array(
        diagnostic(~T.usable(f["words"], f["letters"]), TEXT, "failure", "unusable_text", say("Only ", f["words"], " words of usable text were extracted.")),
        diagnostic((f["chars"] > 0) & (f["bad_chars"] / F.greatest(f["chars"], F.lit(1)) > 0.002), TEXT, "failure", "garbled_text", F.lit("Extracted text contains too many decoding/control characters.")),
        diagnostic(collapsed(f["words"], f["paragraphs"], f["largest"]), TEXT, "failure", "collapsed_paragraphs", say("Paragraph boundaries collapsed: largest paragraph has ", f["largest"], " of ", f["words"], " words.")),
        diagnostic(
            f["ornaments"] > 0,
            TEXT,
            F.when(heavy, "failure").otherwise("warning"),
            "ornament_junk",
            F.when(heavy, say(f["ornaments"], " isolated scene ornaments leaked into readable paragraphs.")).otherwise(say(f["ornaments"], " isolated ornament paragraph", plural, " should be manually reviewed.")),
        ),
    )
    too_many = F.array(diagnostic(many, OTHER, "failure", "too_many_paragraphs", say("This book has ", f["paragraphs"], f" paragraphs; maximum supported is {S.MAX_PARAGRAPHS}.")))
    fired = F.filter(F.when(many, too_many).otherwise(rules), lambda d: d.isNotNull())
    return facts.select(key, F.posexplode(fired).alias("pos", "d")).select(key, "pos", "d.*")


def chapter_diagnostics(chapters: DataFrame, books: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rules over chapter lists. ``chapters``: key, chapter_index, title, start_paragraph_id; ``books``: key, paragraphs, one row a book."""
    listed = chapters.where(F.col(key).isNotNull()).select(key, F.lit(True).alias("entry"), "chapter_index", (~T.sane_title("title")).alias("nonsense"), "start_paragraph_id")
    return entry_diagnostics(listed.unionByName(books.select(key, F.lit(False).alias("entry"), "paragraphs"), allowMissingColumns=True), key)


def entry_diagnostics(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same from narrow rows: an ``entry`` with chapter_index, nonsense (whether its title is no title) and start_paragraph_id, or a book with its number of paragraphs, which
    entries may have as well; other entries are of no book and are left out."""
    # a book's own row comes first, so that its number is known to all entries
    w = Window.partitionBy(key).orderBy("entry", "chapter_index")
    start, entry = F.col("start_paragraph_id"), F.col("entry")
    at = rows.withColumns({"prev": F.lag(F.when(entry, start).otherwise(0), 1, 0).over(w), "of": F.max("paragraphs").over(w)})
    bad = entry & ((start < 1) | (start > F.col("of")) | (start < F.col("prev")))
    facts = at.groupBy(key).agg(F.count_if(entry & F.col("nonsense")).alias("nonsense"), F.count_if(bad).alias("invalid"), F.count_if(entry).alias("n"), F.count_distinct("start_paragraph_id").alias("starts"), F.bool_or(~entry | F.col("paragraphs").isNotNull()).alias("known")).where("known")
    fired = F.array(
        diagnostic(F.col("n") == 0, CHAPTERS, "failure", "weak_chapters", F.lit("No chapter/navigation entry was extracted.")),
        diagnostic((F.col("nonsense") > 0) | (F.col("invalid") > 0), CHAPTERS, "failure", "weak_chapters", say("Chapter list contains ", F.col("nonsense"), " nonsense titles and ", F.col("invalid"), " invalid starts.")),
        diagnostic((F.col("n") >= 4) & (F.col("starts") / F.greatest(F.col("n"), F.lit(1)) < 0.4), CHAPTERS, "failure", "weak_chapters", F.lit("Chapter entries collapse to too few distinct paragraph starts.")),
    )
    return facts.select(key, F.posexplode(F.filter(fired, lambda d: d.isNotNull())).alias("pos", "d")).select(key, (F.col("pos") + 10).alias("pos"), "d.*")


def source_valid(src: Column, fmt: Column) -> Column:
    s = F.trim(src)
    return (F.length(s) > 0) & ~s.startswith("blob:") & ~s.rlike(r"(?i)^javascript:") & ((fmt != "pdf") | s.rlike(r"^pdf://page/[0-9]+(?:/image/[0-9]+)?(?:[?#].*)?\z"))


def image_diagnostics(images: DataFrame, books: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rules over images; the previous anchor advances on every row. ``books``: key, paragraphs, format, declared."""
    w = Window.partitionBy(key).orderBy("image_index")
    at = images.join(books, key).withColumn("prev", F.lag("after_paragraph_id", 1, 0).over(w))
    anchored = F.col("after_paragraph_id").between(0, F.col("paragraphs")) & (F.col("after_paragraph_id") >= F.col("prev"))
    big = F.trim("src").startswith("data:") & (F.length(F.trim("src")) > S.MAX_INLINE_MEDIA)
    facts = at.groupBy(key).agg(F.count_if(~(anchored & source_valid(F.col("src"), F.col("format")))).alias("invalid"), F.count_if(big).alias("inline"), F.count("*").alias("n"))
    facts = books.select(key, "declared").join(facts, key, "left").na.fill(0)
    fired = F.array(
        diagnostic(F.col("invalid") > 0, IMAGES, "failure", "images_invalid", say(F.col("invalid"), " images have invalid pointers or reading-order anchors.")),
        diagnostic(F.col("inline") > 0, IMAGES, "failure", "images_inline_payload", say(F.col("inline"), " in-book images were eagerly materialized as large inline payloads.")),
        diagnostic((F.col("declared") >= 3) & (F.col("n") == 0), IMAGES, "failure", "images_undeclared", say(F.col("declared"), " image resources were declared but no in-book image was anchored.")),
    )
    return facts.select(key, F.posexplode(F.filter(fired, lambda d: d.isNotNull())).alias("pos", "d")).select(key, (F.col("pos") + 20).alias("pos"), "d.*")


def valid_images(images: DataFrame, books: DataFrame, key: str = "doc_id") -> DataFrame:
    """The images worth storing, renumbered. The anchor to beat advances on kept rows only: kept anchors never fall, so it
    is the running maximum of the anchors of well-formed rows in range before."""
    src = F.trim("src")
    formed = images.join(books, key).where(F.col("after_paragraph_id").between(0, F.col("paragraphs")) & source_valid(F.col("src"), F.col("format")) & ~(src.startswith("data:") & (F.length(src) > S.MAX_INLINE_MEDIA)))
    w = Window.partitionBy(key).orderBy("image_index")
    kept = formed.withColumn("best", F.coalesce(F.max("after_paragraph_id").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("after_paragraph_id >= best")
    return kept.select(key, (F.row_number().over(w) - 1).alias("image_index"), "after_paragraph_id", "src")


def scalar_diagnostics(books: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cover, totals and timing. ``books``: key, cover_src, total_ms, totals_ok."""
    cover = F.coalesce(T.normalize_text("cover_src"), F.lit(""))
    fired = F.array(
        diagnostic(cover == "", COVER, "warning", "cover_missing", F.lit("No reasonable library cover was found.")),
        diagnostic(F.col("cover_src").startswith("data:") & (F.length("cover_src") > S.MAX_INLINE_MEDIA), IMAGES, "failure", "cover_inline_payload", F.lit("The cover pointer contains an unexpectedly large inline payload.")),
        diagnostic(~F.col("totals_ok"), OTHER, "failure", "totals_mismatch", F.lit("Output totals do not match the emitted model arrays.")),
        diagnostic(F.col("total_ms").isNull() | F.isnan("total_ms") | (F.col("total_ms") < 0), OTHER, "failure", "timing_invalid", F.lit("Parser timing is missing or invalid.")),
        diagnostic(F.col("total_ms") > 30_000, TIME, "failure", "timeout", say("Parsing took ", T.js_round(F.col("total_ms")), " ms, exceeding the 30-second ceiling.")),
    )
    return books.select(key, F.posexplode(F.filter(fired, lambda d: d.isNotNull())).alias("pos", "d")).select(key, (F.col("pos") + 30).alias("pos"), "d.*")


def paragraph_facts(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Facts about emitted paragraphs: those of ``text_facts``, empty ones, the first wrong number (from 0, and what stands there), scene breaks and those before the first paragraph.

    ``paragraphs``: key, place (order, whole numbers), id, text, scene. Everything is a sum, a maximum or a minimum, so that a book of any size is aggregated in parts.
    """
    from leafmill.operators.prefix import running_sum

    at = running_sum(paragraphs, key, "place", [], F.lit(1), "nth")
    at = at.withColumns({"index": F.col("nth") - 1, "words": T.count_words("text")})
    wrong = F.when(F.col("id") != F.col("nth"), F.struct("index", "id"))
    broken = F.col("scene").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return at.groupBy(key).agg(
        F.count("*").alias("paragraphs"),
        total("words").alias("words"),
        total(T.letters("text")).alias("letters"),
        (total(F.length("text") + 1) - 1).alias("chars"),
        total(F.regexp_count("text", F.lit(r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F]"))).alias("bad_chars"),
        F.coalesce(F.max("words"), F.lit(0)).alias("largest"),
        F.count_if(T.raw_ornament("text")).alias("ornaments"),
        F.count_if(T.normalize_text("text") == "").alias("empty"),
        F.min(wrong).alias("wrong"),
        F.count_if(broken).alias("breaks"),
        F.count_if(broken & (F.col("id") <= 1)).alias("unanchored"),
    )


def paragraph_diagnostics(facts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rules over empty paragraphs, numbers and scene breaks, from ``paragraph_facts``."""
    n, breaks, at = F.col("paragraphs"), F.col("breaks"), F.col("wrong.index")
    fired = F.array(
        diagnostic(F.col("empty") > 0, TEXT, "failure", "empty_paragraphs", say(F.col("empty"), " empty paragraphs were emitted.")),
        diagnostic(F.col("wrong").isNotNull(), IDS, "failure", "bad_paragraph_ids", say("Paragraph index ", at, " has id ", F.coalesce(F.col("wrong.id").cast("string"), F.lit("missing")), "; expected ", at + 1, ".")),
        diagnostic(F.col("unanchored") > 0, IDS, "failure", "bad_paragraph_ids", say(F.col("unanchored"), " scene breaks are not anchored between real paragraphs.")),
        diagnostic((breaks > 20) & (breaks / F.greatest(n, F.lit(1)) > 0.35), TEXT, "failure", "scene_break_density", say("Scene-boundary density is implausible: ", breaks, " breaks across ", n, " paragraphs.")),
    )
    return facts.select(key, F.posexplode(F.filter(fired, lambda d: d.isNotNull())).alias("pos", "d")).select(key, (F.col("pos") + 4).alias("pos"), "d.*")


def validate_books(paragraphs: DataFrame, chapters: DataFrame, images: DataFrame, books: DataFrame, given: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """All rules over whole books, each finding once: (key, pos, bucket, severity, code, message). A book with too many paragraphs gets that finding alone.

    ``books``: key, format, declared (images), cover_src, total_ms, totals_ok; ``given``: findings of the parser (pos below 0 come first). ``chapters`` and ``images`` as their rules take them.
    """
    none = {c: 0 for c in ("paragraphs", "words", "letters", "chars", "bad_chars", "largest", "ornaments", "empty", "breaks", "unanchored")}
    facts = books.select(key).join(paragraph_facts(paragraphs, key), key, "left").na.fill(none)
    sized = books.join(facts.select(key, "paragraphs"), key)
    found = [text_diagnostics(facts, key), paragraph_diagnostics(facts, key), chapter_diagnostics(chapters, sized.select(key, "paragraphs"), key), image_diagnostics(images, sized.select(key, "paragraphs", "format", "declared"), key), scalar_diagnostics(sized, key)]
    every = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).unionByName(found[4])
    many = facts.where(F.col("paragraphs") > S.MAX_PARAGRAPHS).select(key)
    every = every.join(many, key, "left_anti").unionByName(every.where("code = 'too_many_paragraphs'").join(many, key, "left_semi"))
    return distinct_diagnostics(every.unionByName(given) if given is not None else every, key)


def distinct_diagnostics(diagnostics: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first of each (code, bucket, severity, message) of a book."""
    w = Window.partitionBy(key, "code", "bucket", "severity", "message").orderBy("pos")
    return diagnostics.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def verdicts(books: DataFrame, diagnostics: DataFrame, key: str = "doc_id") -> DataFrame:
    """Whether each book passes: no diagnostic of severity failure."""
    failed = diagnostics.groupBy(key).agg(F.count_if(F.col("severity") == "failure").alias("failures"))
    return books.select(key).join(failed, key, "left").select(key, (F.coalesce("failures", F.lit(0)) == 0).alias("pass"))


#: What a soft code tells the reader.
WARNINGS = {
    "images_invalid": ("images_missing", "Some pictures are missing."),
    "images_inline_payload": ("images_missing", "Some pictures are missing."),
    "images_undeclared": ("images_missing", "Some pictures are missing."),
    "cover_missing": ("cover_missing", "No cover image was found."),
    "cover_inline_payload": ("cover_missing", "No cover image was found."),
    "weak_chapters": ("weak_chapters", "Chapter list may be incomplete or unclear."),
    "garbled_text": ("garbled_text", "Some text may sound wrong in speech or speed reading."),
    "ornament_junk": ("ornament_junk", "Some decorative marks may appear as text."),
    "picture_heavy": ("picture_heavy", "This book has little text relative to pictures."),
    "empty_paragraphs": ("empty_paragraphs", "Some empty paragraphs were skipped or kept as blanks."),
}


def resolve_code(code: Column, bucket: Column, message: Column) -> Column:
    """The code, or one guessed from bucket and message for diagnostics without."""
    m = F.lower(message)
    return (
        F.when(F.trim(code) != "", code)
        .when(bucket == IMAGES, "images_invalid")
        .when(bucket == COVER, "cover_missing")
        .when(bucket == CHAPTERS, "weak_chapters")
        .when(bucket == IDS, "bad_paragraph_ids")
        .when(bucket == TIME, "timeout")
        .when(m.contains("decoding/control") | m.contains("replacement or private-use"), "garbled_text")
        .when(m.contains("ornament"), "ornament_junk")
        .when(m.contains("most pdf pages lack usable"), "picture_heavy")
        .when(m.contains("empty paragraphs"), "empty_paragraphs")
        .when(m.contains("only ") & m.contains("words"), "unusable_text")
        .when(m.contains("collapsed"), "collapsed_paragraphs")
        .when(m.contains("scene-boundary density"), "scene_break_density")
    )


def classified(diagnostics: DataFrame) -> DataFrame:
    """Adds resolved code, disposition (soft or hard), warning code and text; severity is kept beside."""
    code = resolve_code(F.col("code"), F.col("bucket"), F.col("message"))
    soft = (F.col("severity") == "warning") | F.coalesce(code.isin(*S.SOFT_CODES), F.lit(False))
    known = F.create_map(*[F.lit(x) for k, v in WARNINGS.items() for x in (k, v[0])])
    told = F.create_map(*[F.lit(x) for k, v in WARNINGS.items() for x in (k, v[1])])
    return diagnostics.withColumns({"resolved": code, "disposition": F.when(soft, "soft").otherwise("hard"), "warning": F.coalesce(F.try_element_at(known, code), code, F.lit("import_warning")), "told": F.coalesce(F.try_element_at(told, code), F.col("message"))})


def classify(diagnostics: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, hard_code, warnings): the first hard failure, and the first warning of each code in order."""
    c = classified(diagnostics)
    hard = F.min(F.when((F.col("disposition") == "hard") & (F.col("severity") == "failure"), F.struct("pos", "resolved")))
    first = c.where("disposition = 'soft'").groupBy(key, "warning").agg(F.min("pos").alias("pos"))
    lists = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "warning"))), lambda x: x["warning"]).alias("warnings"))
    return c.groupBy(key).agg(hard.alias("h")).join(lists, key, "left").select(key, F.col("h.resolved").alias("hard_code"), F.array_join(F.coalesce("warnings", F.array().cast("array<string>")), ",").alias("warnings"))
