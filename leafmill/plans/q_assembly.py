"""Queries over books put together from parts; lines of documents stand in for extracted paragraphs, with gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import assembly as A
from leafmill.plans import sql as Q
from leafmill.plans.q_text import paras
from leafmill.plans.registry import query, table

_CLEAN = f"""{Q.PARAGRAPHS}, n AS (SELECT doc_id AS book, count(*) AS n FROM p GROUP BY doc_id),
e AS (SELECT doc_id AS book, 'nav' AS source, paragraph_id AS ord, text AS title, CASE WHEN n % 3 = 0 THEN 1 ELSE paragraph_id + 2 END AS s FROM p JOIN n ON book = doc_id WHERE n % 5 > 0
  UNION ALL SELECT doc_id, 'ncx', paragraph_id, text, CASE WHEN n % 4 = 0 THEN 2 ELSE paragraph_id END FROM p JOIN n ON book = doc_id WHERE n % 7 > 2
  UNION ALL SELECT doc_id, 'headings', paragraph_id, text, paragraph_id - 1 FROM p WHERE length(text) < 60
  UNION ALL SELECT doc_id, 'files', paragraph_id, text, paragraph_id FROM p WHERE paragraph_id = 1),
k AS (SELECT e.book, source, ord, {Q.norm('title')} AS title, greatest(1, least(n, s)) AS s FROM e JOIN n USING (book)),
c AS (SELECT * FROM k WHERE length(title) BETWEEN 1 AND 240 AND regexp_matches(title, '[\\p{{L}}\\p{{N}}]') QUALIFY row_number() OVER (PARTITION BY book, source, lower(title), s ORDER BY ord) = 1),
f AS (SELECT n.book, count(*) FILTER (source = 'nav') AS a, count(DISTINCT s) FILTER (source = 'nav') AS da, count(*) FILTER (source = 'ncx') AS b, count(DISTINCT s) FILTER (source = 'ncx') AS db, count(*) FILTER (source = 'headings') AS h, count(*) FILTER (source = 'files') AS x FROM n LEFT JOIN c USING (book) GROUP BY n.book),
g AS (SELECT *, a >= 4 AND da / a < 0.4 AS fa, b >= 4 AND db / b < 0.4 AS fb FROM f),
w AS (SELECT *, CASE WHEN NOT fa AND a > 0 AND (fb OR db <= 1 OR da >= ceil(db / 2)) THEN 'nav' WHEN NOT fb AND b > 0 AND (NOT fa OR db >= 2 OR h = 0) THEN 'ncx' WHEN h > 0 THEN 'headings' WHEN x > 0 THEN 'files' ELSE 'single' END AS source FROM g)"""


def _lists(spark, sf_dir):
    p = paras(spark, sf_dir).withColumnRenamed("doc_id", "book")
    counts = p.groupBy("book").agg(F.count("*").alias("n"))
    p = p.join(counts, "book")
    k, n = F.col("paragraph_id"), F.col("n")
    row = lambda source, rows, start: rows.select("book", F.lit(source).alias("source"), k.alias("ord"), F.col("text").alias("title"), start.alias("start_paragraph_id"))
    lists = row("nav", p.where(n % 5 > 0), F.when(n % 3 == 0, 1).otherwise(k + 2)).unionByName(row("ncx", p.where(n % 7 > 2), F.when(n % 4 == 0, 2).otherwise(k)))
    lists = lists.unionByName(row("headings", p.where(F.length("text") < 60), k - 1)).unionByName(row("files", p.where(k == 1), k))
    return lists, counts.withColumn("title", F.when(F.col("book") % 2 == 1, "A Book").otherwise(""))


@query(f"""WITH {_CLEAN} SELECT book, source, ord::BIGINT AS ord, title, s::BIGINT AS start_paragraph_id FROM c JOIN w USING (book, source)
UNION ALL SELECT book, source, 0, CASE WHEN book % 2 = 1 THEN 'A Book' ELSE 'Start' END, 1 FROM w WHERE source = 'single'""")
def chosen_chapters(spark, sf_dir):
    return A.choose_chapters(*_lists(spark, sf_dir))[0]


@query(f"""WITH {_CLEAN} SELECT book, 'Weak / missing / nonsense chapters' AS bucket, CASE WHEN source = 'headings' THEN 'warning' ELSE 'failure' END AS severity,
CASE WHEN source = 'headings' AND (fa OR fb) THEN 'Navigation targets collapsed to too few positions; headings were used as chapters'
  WHEN source = 'headings' THEN 'Navigation TOC was unavailable; headings were used as chapters'
  WHEN source = 'files' AND (fa OR fb) THEN 'Navigation targets collapsed and headings were unavailable; file boundaries are not trusted as chapters'
  WHEN source = 'files' THEN 'Navigation TOC and headings were unavailable; file boundaries are not trusted as chapters' ELSE 'No trustworthy chapter structure was found' END AS message FROM w WHERE source NOT IN ('nav', 'ncx')""")
def weak_chapter_diagnostics(spark, sf_dir):
    return A.choose_chapters(*_lists(spark, sf_dir))[1]


_BOOK = f"""l AS (SELECT doc_id AS book, generate_subscripts(s, 1) * 2 AS place, unnest(s) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
t AS (SELECT book, place, {Q.norm('raw')} AS text, CASE WHEN place % 14 = 0 THEN 'rule' END AS scene, length(raw) AS len FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY place) AS id FROM t WHERE text <> ''), n AS (SELECT d.book, coalesce(n, 0) AS n FROM (SELECT doc_id AS book FROM documents) d LEFT JOIN (SELECT book, count(*) AS n FROM o GROUP BY book) USING (book)),
placed AS (SELECT t.*, n.n, (SELECT count(*) FROM o WHERE o.book = t.book AND o.place < t.place - 1) + 1 AS odd_start, (SELECT count(*) FROM o WHERE o.book = t.book AND o.place <= t.place) AS upto FROM t JOIN n USING (book)),
c0 AS (SELECT book, place AS pos, text AS title, odd_start AS start, n FROM placed WHERE length(text) < 80 UNION ALL SELECT book, place + 1000000, text, odd_start, n FROM placed WHERE length(text) < 80),
c1 AS (SELECT book, pos, title, least(greatest(n, 1), start) AS start FROM c0 WHERE length(title) BETWEEN 1 AND 240 QUALIFY row_number() OVER (PARTITION BY book, lower(title), least(greatest(n, 1), start) ORDER BY pos) = 1),
c2 AS (SELECT *, {Q.nav_kind('title')} AS kind FROM c1),
c3 AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY start, CASE kind WHEN 'frontmatter' THEN 0 WHEN 'part' THEN 1 WHEN 'chapter' THEN 2 WHEN 'section' THEN 3 WHEN 'scene' THEN 4 ELSE 5 END, pos) - 1 AS i FROM c2),
im AS (SELECT book, place AS ord, upto AS after FROM placed), an AS (SELECT book, place, greatest(1, least(n, odd_start)) AS id FROM placed),
pa AS (SELECT o.book, o.id, o.text, CASE WHEN o.id > 1 AND NOT EXISTS (SELECT 1 FROM c0 WHERE c0.book = o.book AND c0.start = o.id) THEN o.scene END AS scene FROM o)"""


def _parts(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    at = lines.select("book", ((F.col("at") + 1) * 2).alias("place"), "text")
    k = F.col("place")
    paragraphs = at.withColumn("scene", F.when(k % 14 == 0, "rule"))
    titles = at.where(F.length(_clean("text")) < 80).select("book", k.alias("ord"), _clean("text").alias("title"), (k - 1).alias("place"))
    again = titles.select("book", (F.col("ord") + 1_000_000).alias("ord"), "title", "place")
    images = at.select("book", k.alias("ord"), F.lit("a  picture").alias("alt"), F.lit("i.png").alias("src"), "place")
    anchors = at.select("book", F.lit("a.xhtml").alias("path"), k.cast("string").alias("fragment"), (k - 1).alias("place"))
    return A.build_books(lines.select("book").distinct(), paragraphs, titles.unionByName(again), images, anchors)


def _clean(c):
    from leafmill.functions import text as T

    return T.normalize_text(c)


@query(f"""WITH {_BOOK}, w AS (SELECT book, sum(len({Q.tokens('text')})) AS words FROM pa GROUP BY book)
SELECT n.book, n.n AS paragraphs, coalesce(words, 0)::BIGINT AS words, (SELECT count(*) FROM c3 WHERE c3.book = n.book) AS chapters, (SELECT count(*) FROM im WHERE im.book = n.book) AS images, (SELECT count(*) FROM pa WHERE pa.book = n.book AND scene IS NOT NULL) AS scene_breaks FROM n LEFT JOIN w USING (book)""")
def built_books(spark, sf_dir):
    return _parts(spark, sf_dir).totals


@query(f"""WITH {_BOOK} SELECT book, 'paragraph' AS part, id::BIGINT AS ord, id::BIGINT AS paragraph_id, text, scene AS extra FROM pa
UNION ALL SELECT book, 'chapter', i, start, title, kind FROM c3 UNION ALL SELECT book, 'image', ord, after, 'a picture', 'i.png' FROM im UNION ALL SELECT book, 'anchor', place - 1, id, place::VARCHAR, 'a.xhtml' FROM an""")
def built_book_parts(spark, sf_dir):
    b = _parts(spark, sf_dir)
    row = lambda part, rows, number, at, text, extra: rows.select("book", F.lit(part).alias("part"), F.col(number).cast("long").alias("ord"), F.col(at).cast("long").alias("paragraph_id"), F.col(text).alias("text"), F.col(extra).alias("extra"))
    out = row("paragraph", b.paragraphs, "id", "id", "text", "scene").unionByName(row("chapter", b.chapters, "chapter_index", "start_paragraph_id", "title", "kind"))
    return out.unionByName(row("image", b.images, "ord", "after_paragraph_id", "alt", "src")).unionByName(row("anchor", b.anchors, "place", "paragraph_id", "fragment", "path"))


@query(f"""WITH {Q.PARAGRAPHS}, e AS (SELECT doc_id AS book, paragraph_id * 3 AS ord, length(text) * 7 % 5 * 2 AS depth FROM p)
SELECT book, ord, depth, (SELECT max(b.ord) FROM e b WHERE b.book = e.book AND b.ord < e.ord AND b.depth < e.depth) AS parent_ord,
  (SELECT max(b.ord) FROM e b WHERE b.book = e.book AND b.ord < coalesce((SELECT min(c.ord) FROM e c WHERE c.book = e.book AND c.ord > e.ord AND c.depth <= e.depth), 1000000000)) AS last_ord FROM e""")
def toc_parents(spark, sf_dir):
    p = paras(spark, sf_dir)
    return A.outline_tree(p.select(F.col("doc_id").alias("book"), (F.col("paragraph_id") * 3).alias("ord"), (F.length("text") * 7 % 5 * 2).alias("depth")))


@query(f"""WITH RECURSIVE {Q.PARAGRAPHS}, i AS (SELECT doc_id AS book, paragraph_id AS id, CASE WHEN paragraph_id > 1 THEN paragraph_id // 2 END AS parent, -paragraph_id % 7 AS position, CASE WHEN paragraph_id % 9 = 0 THEN '_Toc' || paragraph_id ELSE text END AS title, CASE WHEN paragraph_id % 5 > 0 THEN 'd' END AS destination FROM p),
w AS (SELECT book, id, [(position, id)] AS way FROM i WHERE parent IS NULL UNION ALL SELECT i.book, i.id, list_append(w.way, (i.position, i.id)) FROM i JOIN w ON i.book = w.book AND i.parent = w.id)
SELECT w.book, w.id, title, len(way)::INTEGER AS depth, row_number() OVER (PARTITION BY w.book ORDER BY way)::INTEGER AS ord FROM w JOIN i USING (book, id) WHERE length(title) BETWEEN 1 AND 240 AND destination IS NOT NULL AND NOT regexp_matches(title, '(?i)^(_?(hlk|toc)[0-9]+|ole_link[0-9]+)$')""")
def flat_outlines(spark, sf_dir):
    p = paras(spark, sf_dir)
    k = F.col("paragraph_id")
    title = F.when(k % 9 == 0, F.concat(F.lit("_Toc"), k.cast("string"))).otherwise(F.col("text"))
    items = p.select(F.col("doc_id").alias("book"), k.alias("id"), F.when(k > 1, F.floor(k / 2).cast("int")).alias("parent"), (-k % 7).alias("position"), title.alias("title"), F.when(k % 5 > 0, "d").alias("destination"))
    return A.outline_flatten(items).drop("destination")
