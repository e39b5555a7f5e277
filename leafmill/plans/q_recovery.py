"""Queries over tables of contents that need help: paragraphs stand in for entries, landmarks, blocks and chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import chapters as C
from leafmill.operators import recovery as R
from leafmill.plans import sql as Q
from leafmill.plans.q_chapters import _BEFORE, _FRONT, _NORM
from leafmill.plans.q_text import paras
from leafmill.plans.registry import query


def _path(c: str) -> str:
    return rf"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(coalesce({c}, ''), '\', '/'), '^\./', ''), '^(\.\./)+', ''), '(?i)^OEBPS/', ''), '(?i)^OPS/', ''))"


_TYPES = ("toc", "chapter", "index", "unknown", "text", "cover", "notes")
_ENTRIES = rf"""{Q.PARAGRAPHS}, n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
e0 AS (SELECT doc_id AS book_id, paragraph_id AS ord, ([{', '.join(map(repr, _BEFORE))}])[paragraph_id % {len(_BEFORE)} + 1] || text AS title, CASE paragraph_id % 4 WHEN 0 THEN '../OPS/T/' WHEN 1 THEN 'oebps\t\' WHEN 2 THEN './T/' ELSE 'U/' END || (paragraph_id // 3) || '.xhtml' AS file, CASE WHEN paragraph_id % 3 > 0 THEN 'A' || (paragraph_id % 9) END AS anchor FROM p),
e AS (SELECT *, {_path('file')} AS f FROM e0)"""


def _entries(spark, sf_dir):
    k = F.col("paragraph_id")
    before = F.element_at(F.array(*[F.lit(x) for x in _BEFORE]), (k % len(_BEFORE) + 1).cast("int"))
    folder = F.when(k % 4 == 0, "../OPS/T/").when(k % 4 == 1, "oebps\\t\\").when(k % 4 == 2, "./T/").otherwise("U/")
    return paras(spark, sf_dir).select(F.col("doc_id").alias("book_id"), k.alias("ord"), F.concat(before, "text").alias("title"), F.concat(folder, F.floor(k / 3).cast("string"), F.lit(".xhtml")).alias("file"), F.when(k % 3 > 0, F.concat(F.lit("A"), (k % 9).cast("string"))).alias("anchor"))


@query(rf"""WITH {_ENTRIES}, r AS (SELECT p.doc_id AS book_id, paragraph_id AS pos, ([{', '.join(map(repr, _TYPES))}])[paragraph_id * 5 % {len(_TYPES)} + 1] AS type, 't/' || (paragraph_id // 2) || '.xhtml' AS f, 'a' || (paragraph_id % 5) AS anchor FROM p JOIN n USING (doc_id) WHERE n % 2 = 0),
c AS (SELECT *, CASE WHEN type IN ('chapter', 'text') THEN 'main' WHEN type IN ('toc', 'cover') THEN 'front' WHEN type IN ('index', 'notes') THEN 'back' END AS c FROM r WHERE type <> 'unknown'),
a AS (SELECT book_id, f, anchor, arg_min(c, pos) AS by_target FROM c GROUP BY ALL), b AS (SELECT book_id, f, arg_min(c, pos) AS by_file FROM c GROUP BY ALL), x AS (SELECT *, {_NORM.format(c='title')} AS t FROM e), y AS (SELECT *, regexp_replace(t, '[:.;,]+$', '') AS bare FROM x)
SELECT y.book_id, ord, coalesce(by_target, by_file, CASE WHEN (t = 'preface the sea' AND ord <= 2) OR regexp_matches(bare, '^({_FRONT})( |$)') THEN 'front' WHEN regexp_matches(bare, '^(appendix|appendices|glossary|bibliography|index|notes|footnotes|endnotes|colophon|license|licence)( |$)') THEN 'back' ELSE 'unknown' END) AS category
FROM y LEFT JOIN a ON a.book_id = y.book_id AND a.f = y.f AND a.anchor = lower(coalesce(y.anchor, '')) LEFT JOIN b ON b.book_id = y.book_id AND b.f = y.f""")
def classified_toc(spark, sf_dir):
    e = _entries(spark, sf_dir)
    k = F.col("paragraph_id")
    p = paras(spark, sf_dir)
    even = p.groupBy("doc_id").agg(F.count("*").alias("n")).where("n % 2 = 0").select("doc_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in _TYPES]), (k * 5 % len(_TYPES) + 1).cast("int"))
    references = p.join(even, "doc_id").select(F.col("doc_id").alias("book_id"), k.alias("pos"), kind.alias("type"), F.concat(F.lit("T/"), F.floor(k / 2).cast("string"), F.lit(".xhtml")).alias("file"), F.concat(F.lit("A"), (k % 5).cast("string")).alias("anchor"))
    books = e.select("book_id").distinct().withColumn("title", F.lit("Preface the sea"))
    return R.classify_toc(e, references, books).select("book_id", "ord", "category")


@query(rf"""WITH {_ENTRIES}, t AS (SELECT book_id, regexp_extract(f, '[^/]*$') AS name, count(*) AS times FROM e GROUP BY ALL), l AS (SELECT DISTINCT book_id, f FROM e WHERE anchor <> ''),
b AS (SELECT doc_id AS book_id, paragraph_id AS block, CASE WHEN paragraph_id % 2 = 0 THEN 't/' ELSE 'v/' END || (paragraph_id // 3) || '.xhtml' AS f, unnest(list_distinct(['a' || (paragraph_id % 9), 'a' || (paragraph_id % 4)])) AS anchor FROM p), m AS (SELECT b.*, l.f IS NOT NULL AS listed FROM b LEFT JOIN l ON l.book_id = b.book_id AND l.f = b.f)
SELECT DISTINCT m.book_id, block, ord FROM m JOIN e ON e.book_id = m.book_id AND lower(e.anchor) = m.anchor AND ((listed AND e.f = m.f) OR (NOT listed AND regexp_extract(e.f, '[^/]*$') = regexp_extract(m.f, '[^/]*$') AND EXISTS (SELECT 1 FROM t WHERE t.book_id = m.book_id AND t.name = regexp_extract(m.f, '[^/]*$') AND times = 1)))""")
def anchored_entries(spark, sf_dir):
    k = F.col("paragraph_id")
    blocks = paras(spark, sf_dir).select(F.col("doc_id").alias("book_id"), k.alias("block"), F.concat(F.when(k % 2 == 0, "OPS/T/").otherwise("v/"), F.floor(k / 3).cast("string"), F.lit(".xhtml")).alias("file"), F.array(F.concat(F.lit("A"), (k % 9).cast("string")), F.concat(F.lit("a"), (k % 4).cast("string"))).alias("anchors"))
    return R.anchored_entries(blocks, _entries(spark, sf_dir))


@query(rf"""WITH {Q.PARAGRAPHS}, c AS (SELECT doc_id, paragraph_id AS s, CASE WHEN paragraph_id % 3 = 0 THEN 'Elsewhere' ELSE text END AS title FROM p WHERE length(text) < 200), l AS (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS nx FROM c),
j AS (SELECT l.*, h.text AS here, b.text AS behind FROM l LEFT JOIN p h ON h.doc_id = l.doc_id AND h.paragraph_id = s LEFT JOIN p b ON b.doc_id = l.doc_id AND b.paragraph_id = s + 1), n AS (SELECT *, {_NORM.format(c='here')} AS hn, {_NORM.format(c='behind')} AS bn, {_NORM.format(c='title')} AS tn FROM j)
SELECT doc_id AS book_id, s AS pos, title, CASE WHEN coalesce((hn = tn OR (hn <> '' AND (starts_with(hn, tn || ' ') OR hn IN (tn || '.', tn || ',') OR (length(hn) < length(tn) + 15 AND contains(hn, tn)))) OR (length(here) <= 80 AND here = upper(here) AND NOT contains(here, 'ß'))) AND bn <> tn AND length(trim(behind)) >= 2 AND (nx IS NULL OR s + 1 < nx), false) THEN s + 1 ELSE s END AS start FROM n""")
def shifted_starts(spark, sf_dir):
    k = F.col("paragraph_id")
    p = paras(spark, sf_dir).withColumnRenamed("doc_id", "book_id")
    title = F.when(k % 3 == 0, "Elsewhere").otherwise(F.col("text"))
    chapters = p.where(F.length("text") < 200).select("book_id", k.alias("pos"), k.alias("start"), title.alias("title"), C.norm_dedup(title).alias("norm"))
    return R.shift_past_headings(chapters, p).select("book_id", "pos", "title", "start")


_CALLED = rf"""{Q.PARAGRAPHS}, d AS (SELECT doc_id AS book_id, paragraph_id AS id, CASE WHEN paragraph_id % 3 = 1 THEN 'Chapter ' || text ELSE text END AS text FROM p), x AS (SELECT *, {_NORM.format(c='text')} AS t, max(id) OVER (PARTITION BY book_id) AS last FROM d),
i AS (SELECT * FROM x WHERE starts_with(t, 'chapter ') AND NOT contains(t, 'the sea') AND NOT contains(t, 'copyright') AND NOT contains(t, 'short stories') AND length(text) <= 180 AND len(string_split(text, ' ')) <= 24 AND id < last)"""


@query(f"WITH {_CALLED} SELECT book_id, id AS start, text AS title FROM i")
def implicit_headings(spark, sf_dir):
    p, books, _ = _called(spark, sf_dir)
    none = spark.createDataFrame([], "book_id long, ord int, title string, file string, depth int, category string, kind string, norm string, fragment boolean")
    return R.implicit_headings(p, none, books).where("kind = 'chapter'").select("book_id", "start", "title")


def _called(spark, sf_dir):
    k = F.col("paragraph_id")
    p = paras(spark, sf_dir).select(F.col("doc_id").alias("book_id"), "paragraph_id", F.when(k % 3 == 1, F.concat(F.lit("Chapter "), "text")).otherwise(F.col("text")).alias("text"), F.lit("a").alias("file"))
    books = p.select("book_id").distinct().withColumn("title", F.lit("The Sea"))
    return p, books, books.select("book_id", F.lit(1).alias("pos"), F.lit(1).alias("start"), F.lit("An essay").alias("title"))


@query(rf"""WITH {_CALLED}, m AS (SELECT *, count(*) OVER (PARTITION BY book_id) AS n, lead(id) OVER (PARTITION BY book_id ORDER BY id) AS nx FROM i), b AS (SELECT m.*, x.t AS bt, x.text AS bx FROM m LEFT JOIN x ON x.book_id = m.book_id AND x.id = m.id + 1 WHERE n >= 5),
s AS (SELECT *, CASE WHEN bt <> t AND length(trim(bx)) >= 2 AND (nx IS NULL OR id + 1 < nx) THEN id + 1 ELSE id END AS s, contains(t, 'song') OR contains(t, 'chant') AS song FROM b),
g AS (SELECT *, s - lag(s) OVER w AS pg, lag(song) OVER w AS ps, lead(s) OVER w - s AS ng, lead(song) OVER w AS ns FROM s WINDOW w AS (PARTITION BY book_id ORDER BY s)),
k AS (SELECT * FROM g WHERE NOT (song AND (coalesce(ng <= 2 AND NOT ns, false) OR coalesce(pg <= 2 AND NOT ps, false)))), f AS (SELECT *, count(*) OVER (PARTITION BY book_id) AS kn FROM k)
SELECT book_id, s AS start, text AS title FROM f WHERE kn >= 5 UNION ALL SELECT DISTINCT book_id, 1, 'An essay' FROM d WHERE book_id NOT IN (SELECT book_id FROM f WHERE kn >= 5)""")
def preferred_implicit_chapters(spark, sf_dir):
    p, books, chapters = _called(spark, sf_dir)
    return R.prefer_implicit(chapters, p.select("book_id", F.col("paragraph_id").alias("ord"), "text", F.lit("Essay").alias("title"), F.col("paragraph_id").alias("start")), p, books)


@query()
def recovered_chapters(spark, sf_dir):
    """Books of one chapter from their paragraphs' first words as tables of contents; tested against plain loops, since SQL for all steps would be longer than they are."""
    k = F.col("paragraph_id")
    p = paras(spark, sf_dir).select(F.col("doc_id").alias("book_id"), "paragraph_id", "text", F.concat(F.floor(k / 4).cast("string"), F.lit(".xhtml")).alias("file"))
    entries = p.select("book_id", k.alias("ord"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("title"), "file", F.lit("").alias("anchor"), (k % 2 + 1).alias("depth"), F.lit("unknown").alias("category"))
    books = p.select("book_id").distinct().withColumn("title", F.lit("The Sea"))
    return R.recover_collapsed(books.select("book_id", F.lit(1).alias("pos"), F.lit(1).alias("start"), F.lit("An essay").alias("title")), entries, p, books)


@query(rf"""WITH {Q.PARAGRAPHS}, c AS (SELECT doc_id AS book_id, paragraph_id AS pos, CASE WHEN paragraph_id % 17 = 0 THEN paragraph_id - 3 WHEN paragraph_id % 13 = 0 THEN paragraph_id + 40 ELSE paragraph_id END AS s, CASE paragraph_id % 6 WHEN 0 THEN 'Index of all' WHEN 1 THEN 'Preface' ELSE text END AS title FROM p WHERE length(text) < 120), k AS (SELECT doc_id AS book_id, count(*) AS n FROM p GROUP BY doc_id),
a AS (SELECT c.*, k.n, count(*) OVER w0 AS m, coalesce(lag(s) OVER w, 0) AS prev, lead(s) OVER w AS nx FROM c JOIN k USING (book_id) WINDOW w0 AS (PARTITION BY book_id), w AS (PARTITION BY book_id ORDER BY pos)), f AS (SELECT *, sum((s <= prev)::INT) OVER (PARTITION BY book_id ORDER BY pos) AS falls FROM a),
j AS (SELECT f.*, h.text AS here, b.text AS behind FROM f LEFT JOIN p h ON h.doc_id = book_id AND h.paragraph_id = s LEFT JOIN p b ON b.doc_id = book_id AND b.paragraph_id = s + 1), x AS (SELECT *, {_NORM.format(c='title')} AS t, {_NORM.format(c='here')} AS hn FROM j),
g AS (SELECT book_id, max(falls) AS f, count(*) FILTER (falls = 0 AND (s < 1 OR s > n)) AS o, count(*) FILTER (falls = 0 AND m > 1 AND regexp_matches(t, '^(contents|table of contents|copyright|copyright page|title page|cover|preface|foreword|introduction|dedication)( |$)')) AS fm, count(*) FILTER (falls = 0 AND m > 2 AND regexp_matches(t, '^(appendix|appendices|bibliography|index|notes|endnotes|footnotes|glossary|colophon)( |$)')) AS bm,
  count(*) FILTER (m = 1 AND n > 4 AND t <> 'the sea' AND t <> 'full book') AS a, count(*) FILTER (falls = 0 AND coalesce(trim(here), '') = '') AS p, count(*) FILTER (falls = 0 AND length(hn) < 40 AND hn = t AND t <> '' AND length(behind) >= 40 AND (nx IS NULL OR s + 1 < nx)) AS h FROM x GROUP BY book_id),
z AS (SELECT k.book_id, n, concat_ws(',', CASE WHEN f IS NULL THEN 'empty-chapters' END, CASE WHEN a > 0 THEN 'single-chapter-with-toc' END, CASE WHEN f > 0 THEN 'non-monotonic-starts' END, CASE WHEN o > 0 THEN 'invalid-start-id' END, CASE WHEN fm > 0 THEN 'front-matter-chapter' END, CASE WHEN bm > 0 THEN 'back-matter-chapter' END, CASE WHEN p > 0 THEN 'missing-preview' END, CASE WHEN h > 0 THEN 'heading-only-start' END) AS issues FROM k LEFT JOIN g USING (book_id))
SELECT book_id, issues, CASE WHEN n % 11 = 0 THEN 'excluded' WHEN issues <> '' THEN 'flagged' ELSE 'ok' END AS status FROM z""")
def book_audits(spark, sf_dir):
    k = F.col("paragraph_id")
    p = paras(spark, sf_dir).withColumnRenamed("doc_id", "book_id")
    title = F.when(k % 6 == 0, "Index of all").when(k % 6 == 1, "Preface").otherwise(F.col("text"))
    start = F.when(k % 17 == 0, k - 3).when(k % 13 == 0, k + 40).otherwise(k)
    chapters = p.where(F.length("text") < 120).select("book_id", k.alias("pos"), start.alias("start"), C.norm_dedup(title).alias("norm"))
    n = F.col("paragraphs")
    books = p.groupBy("book_id").agg(F.count("*").alias("paragraphs")).select("book_id", "paragraphs", F.lit("the sea").alias("norm"), n.alias("entries"), F.when(n % 11 == 0, "broken").alias("excluded"))
    return C.audit(chapters, books, p)
