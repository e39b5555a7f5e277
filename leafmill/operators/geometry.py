"""Positioned text: lines to columns, paragraphs and headings; outlines and tables of contents to paragraphs.

A page is the unit: windows and greedy folds are partitioned by (book, page), whose size a printed page bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from leafmill.functions import text as T

PAGE = ["book_id", "page"]


def line_paragraphs(lines: DataFrame, gap: float = 1.5) -> DataFrame:
    """Paragraphs as islands of lines: a column change, a step back or a gap beyond ``gap`` times the page's median starts one.

    ``lines``: book_id, page, line_order, col, baseline, font_size, text.
    """
    w = Window.partitionBy(*PAGE).orderBy("line_order")
    step = lines.withColumns({"prev": F.lag("baseline").over(w), "prev_col": F.lag("col").over(w)})
    step = step.withColumn("step", F.when((F.col("col") == F.col("prev_col")) & (F.col("baseline") > F.col("prev")), F.col("baseline") - F.col("prev")))
    typical = step.groupBy(*PAGE).agg(F.median("step").alias("typical"))
    flagged = step.join(typical, PAGE).withColumn("begins", F.col("prev").isNull() | F.col("step").isNull() | (F.col("step") > gap * F.col("typical")))
    island = flagged.withColumn("island", F.sum(F.col("begins").cast("int")).over(w))
    folded = F.transform(F.array_sort(F.collect_list(F.struct("line_order", "text"))), lambda x: x["text"])
    return island.groupBy(*PAGE, "island").agg(T.join_wrapped(folded).alias("text"), F.count("*").alias("lines"), F.max("font_size").alias("font_size"))


def column_order(lines: DataFrame, width: float, text_lines: int = 6) -> DataFrame:
    """Reading order on pages of two columns between lines that span them; by baseline on others. ``lines``: book_id, page, line_id, x_min, x_max, baseline."""
    middle, gutter = width / 2, width * 0.025
    left, right = F.col("x_max") < middle + gutter, F.col("x_min") > middle - gutter
    side = lines.withColumn("side", F.when(left, 1).when(right, 2).otherwise(0))
    page = Window.partitionBy(*PAGE)
    n = F.count("*").over(page)
    side = side.withColumns({"n": n, "nl": F.sum((F.col("side") == 1).cast("int")).over(page), "nr": F.sum((F.col("side") == 2).cast("int")).over(page)})
    two = (F.col("n") >= text_lines) & (F.col("nl") >= 3) & (F.col("nr") >= 3) & (F.col("n") - F.col("nl") - F.col("nr") <= F.col("n") * 0.3)
    below = F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).over(page.orderBy("baseline", "x_min", "line_id").rowsBetween(Window.unboundedPreceding, -1))
    banded = side.withColumns({"two": two, "band": F.coalesce(below, F.lit(0))})
    col = F.when(F.col("two"), F.col("side")).otherwise(0)
    rank = F.when(F.col("two") & (F.col("side") == 0), 3).otherwise(col)
    order = Window.partitionBy(*PAGE).orderBy(F.when(F.col("two"), F.col("band")).otherwise(0), rank, "baseline", "x_min", "line_id")
    return banded.select(*PAGE, "line_id", col.alias("col"), (F.row_number().over(order) - 1).alias("line_order"))


def clusters(values: list[float], tolerance: float) -> Iterator[list[float]]:
    """Greedy groups of sorted values: one joins while it is within the tolerance of the group's running median."""
    from statistics import median

    group: list[float] = []
    for v in sorted(values):
        if group and v - median(group) > tolerance:
            yield group
            group = []
        group.append(v)
    if group:
        yield group


def gap_clusters(gaps: DataFrame, tolerance: float = 0.75) -> DataFrame:
    """(book_id, page, cluster, n, center) of each page's line gaps; a fold over the page's sorted gaps, in which a group is a range of places and its median stands in the middle."""
    slim = gaps.select(F.col("book_id").cast("long").alias("book_id"), F.col("page").cast("long").alias("page"), F.col("gap").cast("double").alias("gap"))
    v, n = F.col("__v"), F.size("__v")
    half = lambda c: F.shiftright(c, 1)
    middle = lambda a, b: (F.get(v, half(a + b - 1)) + F.get(v, half(a + b))) / 2
    kind = "struct<start:int,starts:array<int>>"
    begin = F.struct(F.lit(0).alias("start"), F.array(F.lit(0)).alias("starts")).cast(kind)
    grown = lambda s, i: F.when(F.get(v, i) - middle(s["start"], i) > tolerance, F.struct(i.alias("start"), F.concat(s["starts"], F.array(i)).alias("starts")).cast(kind)).otherwise(s)
    places = F.slice(F.sequence(F.lit(0), n - 1), F.lit(2), n)
    found = slim.groupBy(*PAGE).agg(F.array_sort(F.collect_list("gap")).alias("__v")).where(n > 0).withColumn("__starts", F.aggregate(places, begin, grown, lambda s: s["starts"]))
    groups = F.transform("__starts", lambda a, i: F.struct(a.alias("a"), F.coalesce(F.get("__starts", i + 1), n).alias("b")))
    each = found.select(*PAGE, "__v", F.posexplode(groups).alias("cluster", "g"))
    a, b = F.col("g.a"), F.col("g.b")
    return each.select(*PAGE, "cluster", (b - a).alias("n"), middle(a, b).alias("center"))


def line_clusters(items: DataFrame) -> DataFrame:
    """Text items to lines: by baseline around the running median of the line, then runs between column gaps, joined by gap and punctuation.

    ``items``: book_id, page, seq, text, x_min, x_max, baseline, font_size.
    """
    from statistics import median

    def joined(run: list[dict]) -> str:
        out, last = "", None
        for x in run:
            now = " ".join(x["text"].split())
            if not now:
                continue
            if last is not None:
                tight = now[0] in ",.;:!?%)]}’”" or out[-1:] in "([{‘“"
                if not tight and (last["text"][-1:].isspace() or x["text"][:1].isspace() or x["x_min"] - last["x_max"] > max(0.8, min(last["font_size"], x["font_size"]) * 0.12)):
                    out += " "
            out, last = out + now, x
        return out

    def page(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["baseline"], r["x_min"], r["seq"]))
        lines: list[list[dict]] = []
        for r in rows:
            if lines and abs(r["baseline"] - median(x["baseline"] for x in lines[-1])) <= max(2, min(r["font_size"], median(x["font_size"] for x in lines[-1])) * 0.38):
                lines[-1].append(r)
            else:
                lines.append([r])
        runs: list[list[dict]] = []
        for line in lines:
            line.sort(key=lambda r: r["x_min"])
            for i, r in enumerate(line):
                if i and r["x_min"] - line[i - 1]["x_max"] <= max(24, min(line[i - 1]["font_size"], r["font_size"]) * 4):
                    runs[-1].append(r)
                else:
                    runs.append([r])
        out = [{"book_id": rows[0]["book_id"], "page": rows[0]["page"], "line_id": i, "text": text, "x_min": min(x["x_min"] for x in run), "x_max": max(x["x_max"] for x in run), "baseline": float(median(x["baseline"] for x in run)), "font_size": float(median(x["font_size"] for x in run))} for i, run in enumerate(runs) if (text := joined(run))]
        return pa.Table.from_pylist(out, schema=schema)

    schema = pa.schema([("book_id", pa.int64()), ("page", pa.int64()), ("line_id", pa.int32()), ("text", pa.string()), ("x_min", pa.float64()), ("x_max", pa.float64()), ("baseline", pa.float64()), ("font_size", pa.float64())])
    return items.groupBy(*PAGE).applyInArrow(page, "book_id long, page long, line_id int, text string, x_min double, x_max double, baseline double, font_size double")


def oversized_split(text: Column, least: int = 180, target: int = 280, most: int = 420) -> Column:
    """A long paragraph as sentences packed towards ``target`` words; the whole where that cannot be done.

    A greedy fold over the sentences; a short tail joins the piece before it.
    """
    parts = T.sentence_split(text)
    words = lambda c: T.count_words(c)
    empty = F.array().cast("array<string>")

    def add(out: Column, s: Column) -> Column:
        last = F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(""))
        new = (F.size(out) == 0) | ((words(last) >= least) & (words(last) + words(s) > target))
        return F.when(new, F.concat(out, F.array(s))).otherwise(F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), s))))

    packed = F.aggregate(parts, empty, add)
    tail, before = F.try_element_at(packed, F.lit(-1)), F.try_element_at(packed, F.lit(-2))
    short = (F.size(packed) >= 2) & (words(tail) < least) & (words(before) + words(tail) <= most)
    merged = F.when(short, F.concat(F.slice(packed, F.lit(1), F.greatest(F.size(packed) - 2, F.lit(0))), F.array(F.concat(before, F.lit(" "), tail)))).otherwise(packed)
    good = (words(text) > 420) & (F.size(parts) >= 3) & ~F.exists(parts, lambda s: words(s) > most) & (F.size(merged) >= 2) & ~F.exists(merged, lambda s: words(s) > most)
    return F.when(good, merged).otherwise(F.array(text))


def structural_marker(title: str | Column) -> tuple[Column, Column]:
    """Family (book, chapter, part, section) and order of a numbered title; null for others."""
    t = F.lower(T.normalize_text(title))
    pattern = rf"^(book|chapter|part|section) ([0-9]{{1,3}}|[ivxlcdm]{{1,8}}|{'|'.join(T.NUMBER_WORDS)})(?:[.):\x{{2013}}\x{{2014}}-]|(?![A-Za-z0-9_]))"
    family = F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))
    return family, F.when(family.isNotNull(), T.ordinal_parse(F.regexp_extract(t, pattern, 2)))


def heading_dedup(candidates: DataFrame) -> DataFrame:
    """Of the headings of one key the most prominent, if it leads by 0.12; else all. ``candidates``: book_id, key, start, prominence."""
    w = Window.partitionBy("book_id", "key").orderBy(F.desc("prominence"), F.desc("start"))
    every = Window.partitionBy("book_id", "key")
    ranked = candidates.withColumns({"n": F.row_number().over(w), "second": F.nth_value("prominence", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "best": F.max("prominence").over(every)})
    lead = F.col("second").isNull() | (F.col("best") >= F.col("second") + 0.12)
    return ranked.where((F.col("n") == 1) | ~lead).drop("n", "second", "best")


def numbered_ok(headings: DataFrame, counts: DataFrame) -> DataFrame:
    """Whether numbered chapters rise, are three or more and spread over the book. ``headings``: book_id, start, ord; ``counts``: book_id, paragraphs."""
    w = Window.partitionBy("book_id").orderBy("start")
    steps = headings.where("ord IS NOT NULL").withColumn("falls", F.col("ord") < F.lag("ord").over(w))
    facts = steps.groupBy("book_id").agg(F.count_distinct("ord").alias("n"), F.bool_or(F.coalesce("falls", F.lit(False))).alias("falls"), (F.max("start") - F.min("start")).alias("span"))
    return counts.join(facts, "book_id", "left").select("book_id", F.coalesce((F.col("n") >= 3) & ~F.col("falls") & (F.col("span") >= F.greatest(F.lit(20.0), F.col("paragraphs") * 0.2)), F.lit(False)).alias("reliable"))


def telling(tokens: Column, share: float = 0.8) -> Column:
    """The tokens of a set of which two sets share one at least if their Jaccard similarity reaches ``share``: all but the last ``share`` of each in one order, longer (rarer) ones first."""
    ordered = F.array_sort(F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.transform(F.slice(ordered, F.lit(1), F.size(tokens) - F.ceil(F.size(tokens) * share).cast("int") + 1), lambda x: x["t"])


def alike(left: DataFrame, right: DataFrame, by: list[str], a: str, b: str, share: float = 0.8) -> DataFrame:
    """Pairs of rows of one ``by`` whose token sets ``a`` and ``b`` have a Jaccard similarity of ``share`` or more, with it as ``score``. Pairs come from an equi-join
    on telling tokens of sets of like sizes, not from all pairs that share some word."""
    # a set is one row however many rows have it, and candidates carry its digest and size only
    digest = lambda c: F.unhex(F.md5(F.array_join(F.array_sort(c), " ").cast("binary")))
    sets = lambda df, c, name: df.withColumn(name, digest(F.col(c))).groupBy(*by, name).agg(F.first(c).alias(c))
    x, y = sets(left, a, "__a"), sets(right, b, "__b")
    some = lambda df, c, name, n: df.select(*by, name, F.size(c).alias(n), F.explode(F.transform(telling(F.col(c), share), lambda t: F.xxhash64(t))).alias("token"))
    near = (F.col("__n") >= F.col("__m") * share) & (F.col("__m") >= F.col("__n") * share)
    pairs = some(x, a, "__a", "__n").join(some(y, b, "__b", "__m"), [*by, "token"]).where(near).select(*by, "__a", "__b").distinct()
    held = pairs.join(x, [*by, "__a"]).join(y, [*by, "__b"])
    scored = held.withColumn("score", F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).where(F.col("score") >= share).select(*by, "__a", "__b", "score")
    return left.withColumn("__a", digest(F.col(a))).join(scored, [*by, "__a"]).join(right.withColumn("__b", digest(F.col(b))), [*by, "__b"]).drop("__a", "__b")


def outline_match(outline: DataFrame, headings: DataFrame) -> DataFrame:
    """The heading of each outline title: the same key, else token Jaccard of 0.8 or more, the best and then the first.

    ``outline``: book_id, ord, title; ``headings``: book_id, paragraph_id, title. Titles are exchanged once, by book, and looked up in the task that holds the book; books that are
    too large for that (``grouped.MOST_ROWS``) are matched by joins on keys and telling tokens.
    """
    from leafmill.operators import grouped

    small, large = grouped.split_groups([(outline, "title"), (headings, "title")], ["book_id"])
    key = T.comparable_heading("title").alias("key")
    o = small[0].select("book_id", "ord", F.lit(None).alias("paragraph_id"), key)
    h = small[1].select("book_id", F.lit(None).alias("ord"), "paragraph_id", key, F.lit(True).alias("heading")).where("key <> ''")

    def work(at: tuple, rows: list[tuple]):
        known = None not in at
        titles = grouped.Titles((i, k) for _, i, k, heading in rows if heading and known)
        return [(*at, n, titles.look(k) if known else None) for n, _, k, heading in rows if not heading]

    kind = StructType([StructField(f.name, f.dataType) for f in (outline.schema["book_id"], outline.schema["ord"], headings.schema["paragraph_id"])])
    got = grouped.map_groups(o.withColumn("heading", F.lit(False)).unionByName(h), ["book_id"], kind, work)
    return got if large is None else got.unionByName(outline_match_by_joins(*large))


def outline_match_by_joins(outline: DataFrame, headings: DataFrame) -> DataFrame:
    """``outline_match`` for books of any size."""
    key = lambda df, name: df.withColumn(name, T.comparable_heading("title"))
    from leafmill.session import with_checkpoints

    with_checkpoints(outline.sparkSession)
    o = key(outline, "okey").select("book_id", "ord", "okey")
    # of headings with one key the first stands for all
    h = key(headings, "hkey").groupBy("book_id", "hkey").agg(F.min("paragraph_id").alias("paragraph_id")).where("hkey <> ''")
    same = o.join(h.select("book_id", F.col("hkey").alias("okey"), F.col("paragraph_id").alias("by_key")), ["book_id", "okey"], "left").checkpoint()
    rest = same.where("by_key IS NULL").select("book_id", "okey").distinct()
    like = alike(rest.withColumn("otok", T.token_set("okey")), h.select("book_id", "paragraph_id", T.token_set("hkey").alias("htok")), ["book_id"], "otok", "htok")
    best = like.groupBy("book_id", "okey").agg(F.min_by("paragraph_id", F.struct((-F.col("score")).alias("s"), "paragraph_id")).alias("by_words"))
    return same.join(best, ["book_id", "okey"], "left").select("book_id", "ord", F.coalesce("by_key", "by_words").alias("paragraph_id"))


#: A title within a short paragraph: the paragraph is less than so many characters longer.
NEAR = 15
#: Longer titles are no titles (``functions.text.sane_title``).
TITLE = 240
_POINTS = {"file": 90, "exact": 55, "begins": 25, "short": 10, "early": -30, "primary": 20, "other": 10, "matter": -60, "later_file": 10}  # fixed values: points of a match


def title_keys(norm: Column) -> Column:
    """What a paragraph must hold to stand for a normalised title: (key, whole), the title as a part, and as the whole text the number, the number behind "chapter" and the rest of a numbered one."""
    number, rest = F.regexp_extract(norm, r"^([0-9]+)\.\s*(.+)$", 1), F.regexp_extract(norm, r"^([0-9]+)\.\s*(.+)$", 2)
    entry = lambda key, whole: F.struct(key.alias("key"), F.lit(whole).alias("whole"))
    more = F.when(number != "", F.array(entry(number, True), entry(F.concat(F.lit("chapter "), number), True), entry(rest, True))).otherwise(F.array().cast("array<struct<key:string,whole:boolean>>"))
    return F.concat(F.array(entry(norm, False)), more)


def paragraph_keys(norm: Column, lengths: Column) -> Column:
    """The keys by which titles find a normalised paragraph: its beginnings before a blank, all its parts that are less than ``NEAR`` characters shorter, and the whole.

    Only parts of ``lengths`` (of the book's titles) count, so there are at most ``NEAR`` squared over 2 of them, and the join on a key is exact: it compares no paragraph with a title that
    it doesn't hold.
    """
    n = F.length(norm)
    entry = lambda key, whole: F.struct(key.alias("key"), F.lit(whole).alias("whole"))
    begins = F.transform(F.filter(lengths, lambda m: (m < n) & (F.substring(norm, m + 1, F.lit(1)) == " ")), lambda m: F.substring(norm, F.lit(1), m))
    parts = F.flatten(F.transform(F.filter(lengths, lambda m: (m <= n) & (n < m + NEAR)), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: F.substring(norm, i, m))))
    whole = F.when(n <= TITLE, F.array(entry(norm, True))).otherwise(F.array().cast("array<struct<key:string,whole:boolean>>"))
    return F.concat(F.transform(F.array_distinct(F.concat(begins, parts)), lambda k: entry(k, False)), whole)


def toc_scored_match(toc: DataFrame, paras: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(book_id, ord, score, paragraph_id): the paragraph that an entry of a table of contents most likely means, the first of equals.

    ``toc``: book_id, ord, title (at most 240 characters), file, kind; ``paras``: book_id, paragraph_id, text, file, spine (place of the file), total. A paragraph stands for a title as ``chapters.title_match`` has it; pairs come from
    an equi-join on (book, key) of what both hold. ``files``: book_id, file, spine, total, where ``paras`` does not say these; they are asked for pairs only.
    """
    from leafmill.operators.chapters import PRIMARY, norm_dedup

    t = toc.withColumn("tnorm", norm_dedup(F.col("title"))).where(F.length("tnorm").between(1, TITLE))
    lengths = t.groupBy("book_id").agg(F.collect_set(F.length("tnorm")).alias("lengths"))
    p = paras.withColumnRenamed("file", "pfile").join(lengths, "book_id").withColumn("pnorm", norm_dedup(F.col("text")))
    keyed = t.select("book_id", "ord", "title", "file", "kind", "tnorm", F.explode(title_keys(F.col("tnorm"))).alias("k"))
    held = p.select("book_id", "paragraph_id", "pfile", *([] if files is not None else ["spine", "total"]), F.length("text").alias("n"), F.length("pnorm").alias("pn"), F.xxhash64("pnorm").alias("ph"), F.explode(paragraph_keys(F.col("pnorm"), F.col("lengths"))).alias("k"))
    pairs = keyed.join(held, ["book_id", "k"])
    if files is not None:
        pairs = pairs.join(files.select("book_id", F.col("file").alias("pfile"), "spine", "total"), ["book_id", "pfile"])
    # the key is the title's, so its beginning and its length tell all that the points ask
    # with the file, which only tells that both sides ask for the same of the texts, so that these are exchanged once
    of = F.coalesce(F.col("pfile").cast("string"), F.lit("")).alias("of")
    starts = p.select("book_id", "paragraph_id", of, F.explode(F.filter("lengths", lambda m: F.substring("pnorm", m + 1, F.lit(1)) == " ")).alias("m"), "pnorm").select("book_id", "paragraph_id", "of", F.xxhash64(F.substring("pnorm", F.lit(1), F.col("m"))).alias("th"), F.lit(True).alias("begins"))
    pairs = pairs.withColumns({"th": F.xxhash64("tnorm"), "of": F.coalesce(F.col("pfile").cast("string"), F.lit(""))}).join(starts, ["book_id", "paragraph_id", "of", "th"], "left")
    same = F.col("file").eqNullSafe(F.col("pfile"))
    pts = lambda cond, name: F.when(cond, _POINTS[name]).otherwise(0)
    kind = F.when(F.col("kind").isin(*PRIMARY), _POINTS["primary"]).when(F.col("kind") == "other", _POINTS["other"]).when(F.col("kind").isin("front", "back"), _POINTS["matter"]).otherwise(0)
    exact = (F.col("ph") == F.col("th")) & (F.col("pn") == F.length("tnorm"))
    early = F.col("paragraph_id") <= F.greatest(F.lit(20), F.floor(F.col("total") * 0.05))
    score = pts(same, "file") + pts(exact, "exact") + pts(F.col("begins"), "begins") + pts(F.col("n") <= F.length("title") + 24, "short") + pts(early, "early") + kind + pts(same & (F.col("spine") > 0), "later_file")
    best = pairs.withColumn("score", score).groupBy("book_id", "ord").agg(F.max(F.struct("score", (-F.col("paragraph_id")).alias("p"))).alias("b"))
    return best.select("book_id", "ord", F.col("b.score").alias("score"), (-F.col("b.p")).alias("paragraph_id"))


def best_per_start(chapters: DataFrame) -> DataFrame:
    """One chapter a start: the best score, the longer title, the earlier entry. ``chapters``: book_id, start, pos, title, score."""
    best = F.max_by(F.struct("pos", "title", "score"), F.struct("score", F.length("title").alias("n"), (-F.col("pos")).alias("p")))
    return chapters.groupBy("book_id", "start").agg(best.alias("b")).select("book_id", "start", "b.*")


def page_edge(baseline: Column, height: Column) -> Column:
    """``header``, ``footer`` or null: the outer 15 % of a page."""
    return F.when(baseline <= height * 0.15, "header").when(baseline >= height * 0.85, "footer")


def edge_signature(text: Column) -> Column:
    """What repeats from page to page: page numbers as one, structural headings as they are, digits as ``#`` from three words on."""
    signed = lambda t: (
        F.when(t.rlike(r"^(?:\p{N}+|[ivxlcdm]+)\z"), "<page-number>")
        .when(t.rlike(r"^(?:chapter|part|book|section)(?:[^a-z0-9_]|\z)"), t)
        .when(t.rlike("^[^ ]* [^ ]* "), F.regexp_replace(t, r"\p{N}+", "#"))
        .otherwise(t)
    )
    # each branch asks for the text in lower case, which is made once
    return T.with_normalized(text, lambda n: F.get(F.transform(F.array(F.lower(n)), signed), F.lit(0)))


def furniture_marks(lines: DataFrame) -> DataFrame:
    """Adds what ``drop_furniture`` asks of texts, so that these need not be moved: ``__edge``, ``__legal``, ``__leader``, ``__short`` and ``__sig``, a digest of an edge line's signature.

    ``lines``: text, baseline, height and others. Only edge lines are looked into.
    """
    edge = page_edge(F.col("baseline"), F.col("height"))
    marked = lines.withColumn("__edge", edge)
    at = lambda which, found: F.when(F.col("__edge") == which, found).otherwise(False)
    digest = F.unhex(F.md5(edge_signature(F.col("text")).cast("binary")))
    return marked.withColumns(
        {
            "__legal": at("footer", F.col("text").rlike(r"(?i)^(?:©|copyright(?![A-Za-z0-9_])|doi(?![A-Za-z0-9_]))")),
            "__leader": at("header", F.col("text").rlike(r"…+\s*\p{N}{1,4}\z")),
            "__short": F.length("text") <= 180,
            "__sig": F.when(F.col("__edge").isNotNull(), digest),
        }
    )


def drop_furniture(marked: DataFrame, key: str = "book_id", every_page: DataFrame | None = None) -> DataFrame:
    """The lines that ``without_furniture`` keeps, of lines with ``furniture_marks``: key, page, baseline and others, but not their texts where nobody asks for these."""
    from leafmill.session import with_checkpoints

    with_checkpoints(marked.sparkSession)
    cut = F.min(F.when(F.col("__legal"), F.col("baseline"))).over(Window.partitionBy(key, "page"))
    clear = (F.col("__cut").isNull() | (F.col("baseline") < F.col("__cut") - 1)) & ~F.col("__legal") & ~F.col("__leader")
    at = marked.withColumn("__cut", cut).withColumn("__clear", clear).drop("__cut", "__legal", "__leader").checkpoint()  # read three times; all that looks into texts is done
    parity = lambda n: F.count_if(F.col("page") % 2 == n)
    pages = (at if every_page is None else every_page).select(key, "page").distinct().groupBy(key).agg(parity(1).alias("odd"), parity(0).alias("even"))
    seen = at.where(F.col("__clear") & F.col("__edge").isNotNull() & F.col("__short")).select(key, "__edge", "__sig", "page").distinct().groupBy(key, "__edge", "__sig").agg(parity(1).alias("on_odd"), parity(0).alias("on_even"))
    both, all_pages = F.col("on_odd") + F.col("on_even"), F.col("odd") + F.col("even")
    share = lambda part, whole: (F.col(whole) >= 3) & (F.col(part) / F.col(whole) >= 0.6)
    repeated = seen.where(both >= 3).join(pages, key).where((both / all_pages >= 0.35) | share("on_odd", "odd") | share("on_even", "even")).select(key, "__edge", "__sig")
    return at.where("__clear").join(repeated, [key, "__edge", "__sig"], "left_anti").drop("__edge", "__short", "__sig", "__clear")


def without_furniture(lines: DataFrame, key: str = "book_id", every_page: DataFrame | None = None) -> DataFrame:
    """The lines of pages without what clearly is furniture, and without what recurs at their edges.

    Clear: a footer line of legal matter with all that is below it, and a header line with leaders. Recurring: an edge line
    of at most 180 characters whose signature is at that edge on three pages or more, and on 35 % of the pages, or 60 %
    of the odd or of the even ones where there are three of these. ``lines``: key, page, text, baseline, height and others; ``every_page``: key, page, where
    there are pages without lines, which count among the pages.
    """
    return drop_furniture(furniture_marks(lines), key, every_page).select(lines.columns)
