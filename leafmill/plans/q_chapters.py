"""Queries over chapter lists; orders stand in for tables of contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import chapters as C
from leafmill.plans import sql as Q
from leafmill.plans.q_text import paras
from leafmill.plans.registry import query, table

_KINDS = ("chapter", "other", "part", "front", "other", "scene", "volume")
_TITLES = ("Song of the sea", "Essays", "One", "Works", "Chant", "Two", "By night")
_LIST = f"""ls AS (SELECT o_custkey AS book_id, o_orderkey AS pos, o_orderkey * 3 // 2 AS start, ([{', '.join(map(repr, _KINDS))}])[(o_orderkey % 7 + 1)::INT] AS kind, lower(([{', '.join(map(repr, _TITLES))}])[(o_orderkey // 7 % 7 + 1)::INT]) AS norm FROM orders)"""


def _chapters(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pick = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), (c % 7 + 1).cast("int"))
    return o.select(F.col("o_custkey").alias("book_id"), k.alias("pos"), F.floor(k * 3 / 2).alias("start"), pick(_KINDS, k).alias("kind"), F.lower(pick(_TITLES, F.floor(k / 7))).alias("norm"))


_OUT = ["book_id", "pos", "start", "kind"]


@query(f"""WITH {_LIST}, a AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY start, pos) - 1 AS i FROM ls), b AS (SELECT *, min(i) FILTER (kind IN ('letter', 'chapter', 'numbered')) OVER (PARTITION BY book_id) AS f FROM a) SELECT book_id, pos, start, kind FROM b WHERE f IS NULL OR NOT f BETWEEN 1 AND 3 OR i >= f""")
def drop_prelude(spark, sf_dir):
    return C.drop_prelude(_chapters(spark, sf_dir)).select(_OUT)


@query(f"""WITH {_LIST}, a AS (SELECT *, norm LIKE '%song%' OR norm LIKE '%chant%' AS song FROM ls), b AS (SELECT *, start - lag(start) OVER w AS pg, lag(song) OVER w AS ps, lead(start) OVER w - start AS ng, lead(song) OVER w AS ns FROM a WINDOW w AS (PARTITION BY book_id ORDER BY start, pos))
SELECT book_id, pos, start, kind FROM b WHERE NOT (song AND (coalesce(ng <= 2 AND NOT ns, false) OR coalesce(pg <= 2 AND NOT ps, false)))""")
def drop_songs(spark, sf_dir):
    return C.drop_songs(_chapters(spark, sf_dir)).select(_OUT)


@query(f"""WITH {_LIST}, a AS (SELECT *, count(*) OVER (PARTITION BY book_id, norm) AS n, max(start) OVER (PARTITION BY book_id, norm) AS m, first_value(kind) OVER (PARTITION BY book_id, norm ORDER BY start, pos) AS fk FROM ls) SELECT book_id, pos, start, kind FROM a WHERE n = 1 OR fk IN ('letter', 'chapter', 'numbered', 'front', 'back') OR start = m""")
def later_repeats(spark, sf_dir):
    return C.later_repeats(_chapters(spark, sf_dir)).select(_OUT)


@query(f"""WITH {_LIST}, a AS (SELECT *, lead(start) OVER w - start AS gap, lead(kind) OVER w AS nk, count(*) FILTER (kind IN ('letter', 'chapter', 'numbered')) OVER (PARTITION BY book_id) AS p, count(*) FILTER (kind = 'other') OVER (PARTITION BY book_id) AS o FROM ls WINDOW w AS (PARTITION BY book_id ORDER BY start, pos))
SELECT book_id, pos, start, kind FROM a WHERE NOT (kind IN ('front', 'back') OR coalesce(kind IN ('part', 'book', 'volume') AND gap <= 3 AND nk IN ('letter', 'chapter', 'numbered', 'other') AND (kind = 'volume' OR p >= 5), false) OR (kind IN ('act', 'scene', 'dramatis', 'play-section') AND o >= 5))""")
def drop_containers(spark, sf_dir):
    return C.drop_containers(_chapters(spark, sf_dir)).select(_OUT)


@query("""WITH t AS (SELECT o_custkey AS book_id, o_orderkey % 4 AS depth, o_orderkey AS start FROM orders), g AS (SELECT *, start - lag(start) OVER (PARTITION BY book_id, depth ORDER BY start) AS gap FROM t), s AS (SELECT book_id, depth, count(*) AS n, coalesce(median(gap), 0) AS median_gap FROM g GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n <= 1000 DESC, median_gap >= 5 DESC, n DESC, median_gap DESC, depth) AS k FROM s) SELECT book_id, depth, n, median_gap FROM r WHERE k = 1""")
def toc_depths(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return C.depth_choice(o.select(F.col("o_custkey").alias("book_id"), (F.col("o_orderkey") % 4).alias("depth"), F.col("o_orderkey").alias("start")))


@query("""SELECT p_partkey, CASE WHEN size <= 0 THEN 'file_empty' WHEN size > 5242880 THEN 'file_too_large' WHEN mime NOT IN ('image/jpeg', 'image/png', 'image/webp') THEN 'unsupported_format' WHEN w IS NULL THEN 'decode_failed' WHEN w < 120 OR h < 160 THEN 'dimensions_too_small' END AS error
FROM (SELECT p_partkey, CASE WHEN p_size = 1 THEN 0 ELSE p_retailprice * 4000 END AS size, CASE p_partkey % 4 WHEN 0 THEN 'image/gif' WHEN 1 THEN 'image/png' ELSE 'image/jpeg' END AS mime, CASE WHEN p_size = 7 THEN NULL ELSE p_size * 20 END AS w, p_size * 10 AS h FROM part)""")
def cover_errors(spark, sf_dir):
    s, k = F.col("p_size"), F.col("p_partkey") % 4
    mime = F.when(k == 0, "image/gif").when(k == 1, "image/png").otherwise("image/jpeg")
    return table(spark, sf_dir, "part").select("p_partkey", C.cover_error(F.when(s == 1, 0).otherwise(F.col("p_retailprice") * 4000), mime, F.when(s != 7, s * 20), s * 10).alias("error"))


@query("""WITH i AS (SELECT l_suppkey AS book_id, 0 AS page, l_quantity AS chars, CASE WHEN l_suppkey % 20 < 7 AND l_linenumber < 7 THEN -pi() / 2 + 0.01 WHEN l_suppkey % 20 < 14 AND l_suppkey % 20 > 6 THEN pi() / 2 - 0.02 ELSE 0.0 END AS angle FROM lineitem),
t AS (SELECT *, CASE WHEN abs(angle + pi() / 2) <= 0.13962634 THEN 90 WHEN abs(angle - pi() / 2) <= 0.13962634 THEN 270 END AS turn FROM i), s AS (SELECT book_id, page, turn, sum(chars) AS c, count(*) AS n FROM t GROUP BY ALL), p AS (SELECT book_id, page, sum(c) AS a FROM s GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY book_id, page ORDER BY c DESC, n DESC) AS k FROM s WHERE turn IS NOT NULL) SELECT p.book_id, p.page, CASE WHEN b.n >= 20 AND b.c >= 120 AND b.c / greatest(a, 1) >= 0.8 THEN turn END AS rotation FROM p LEFT JOIN b ON p.book_id = b.book_id AND k = 1""")
def quarter_turns(spark, sf_dir):
    k, pi = F.col("l_suppkey") % 20, F.pi()
    angle = F.when((k < 7) & (F.col("l_linenumber") < 7), -pi / 2 + 0.01).when((k < 14) & (k > 6), pi / 2 - 0.02).otherwise(0.0)
    return C.quarter_turn(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("book_id"), F.lit(0).alias("page"), F.col("l_quantity").alias("chars"), angle.alias("angle")))


@query("""WITH v AS (SELECT c_custkey // 30 AS lang, c_custkey AS "index", CASE c_custkey % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' ELSE 'unknown' END AS gender, (CASE WHEN c_custkey % 5 = 0 THEN 4 ELSE 0 END + CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END + 1) AS score FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, gender ORDER BY score DESC, "index") AS r FROM v), g AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN gender = 'female' AND r = 1 THEN 0 WHEN gender = 'male' AND r = 1 THEN 1 WHEN gender = 'unknown' THEN 2 WHEN gender = 'female' THEN 3 ELSE 4 END, r) AS n FROM r) SELECT lang, "index", score FROM g WHERE n <= 2""")
def two_voices(spark, sf_dir):
    c = F.col("c_custkey")
    gender = F.when(c % 3 == 0, "female").when(c % 3 == 1, "male").otherwise("unknown")
    return C.two_voices(table(spark, sf_dir, "customer").select(F.floor(c / 30).alias("lang"), c.alias("index"), F.col("c_name").alias("name"), gender.alias("gender"), (c % 5 == 0).alias("is_default"), (c % 2 == 0).alias("local")))


@query(f"""WITH ls AS (SELECT o_custkey AS book_id, o_orderkey AS pos, CASE WHEN o_orderkey % 211 = 0 THEN 1 ELSE o_orderkey END AS start FROM orders), a AS (SELECT *, coalesce(lag(start) OVER (PARTITION BY book_id ORDER BY pos), 0) AS prev FROM ls), b AS (SELECT *, sum((start <= prev)::INT) OVER (PARTITION BY book_id ORDER BY pos) AS falls FROM a),
f AS (SELECT book_id, max(falls) AS f, count(*) FILTER (falls = 0 AND (start < 1 OR start > 1400)) AS o FROM b GROUP BY book_id) SELECT book_id, concat_ws(',', CASE WHEN f > 0 THEN 'non-monotonic-starts' END, CASE WHEN o > 0 THEN 'invalid-start-id' END) AS issues, CASE WHEN f > 0 OR o > 0 THEN 'flagged' ELSE 'ok' END AS status FROM f""")
def chapter_audits(spark, sf_dir):
    at = _chapters(spark, sf_dir).withColumn("start", F.when(F.col("pos") % 211 == 0, 1).otherwise(F.col("pos")))
    return C.audit(at, at.select("book_id").distinct().withColumn("paragraphs", F.lit(1400)))


_NORM = r"lower(trim(regexp_replace(strip_accents(nfc_normalize({c})), '\s+', ' ', 'g')))"
_FRONT = "cover|title page|half title|contents|table of contents|illustrations|copyright|copyright page|dedication|preface|foreword|introduction"
#: Beginnings that make titles of all kinds, put before paragraphs by turns.
_BEFORE = ("", "Chapter ", "letter ", "Vol.2 ", "vol. 2 ", "PART", "Book: ", "Act I. ", "Second  act ", "actor ", "[ A ]", "Scene. ", "Dramatis Personae ", "IV. ", "12: ", "Epilogue, ", "Preface ", "The Copyright of ", "volumes ", "3x ", "Lettera ")


@query(rf"""WITH {Q.PARAGRAPHS}, x AS (SELECT doc_id, paragraph_id, ([{', '.join(map(repr, _BEFORE))}])[paragraph_id % {len(_BEFORE)} + 1] || text AS title FROM p), n AS (SELECT *, {_NORM.format(c='title')} AS t FROM x), b AS (SELECT *, regexp_replace(t, '[:.;,]+$', '') AS bare FROM n)
SELECT doc_id, paragraph_id, title, CASE WHEN regexp_matches(trim(title), '^\[\s*[A-Z]\s*\]$') THEN 'front' WHEN contains(t, 'project gutenberg') OR contains(t, 'full license') OR contains(t, 'copyright') OR t IN ('the end', 'finis') THEN 'back'
  WHEN regexp_matches(bare, '^({_FRONT})( |$)') OR regexp_matches(t, '^(illustrated by |translated from |translated by |bibliographical note|original short stories)') OR contains(t, 'short stories') OR t IN ('prologue', 'the prologue', 'epilogue', 'or') THEN 'front'
  WHEN length(t) >= 5 AND NOT (trim(title) = upper(trim(title)) AND regexp_matches(title, '[A-Z]')) AND (contains('the sea', t) OR contains(t, 'the sea') OR contains(trim(regexp_replace(regexp_replace(t, '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), 'the sea') OR contains('the sea', trim(regexp_replace(regexp_replace(t, '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')))) THEN 'front'
  WHEN regexp_matches(t, '^letter\b') THEN 'letter' WHEN regexp_matches(t, '^chapter\b') THEN 'chapter' WHEN regexp_matches(t, '^book\b') THEN 'book' WHEN regexp_matches(t, '^part\b') THEN 'part' WHEN regexp_matches(t, '^(volume|vol\.)\b') THEN 'volume'
  WHEN regexp_matches(t, '^((first|second|third|fourth|fifth)\s+)?act\b') THEN 'act' WHEN regexp_matches(t, '^scene\b') THEN 'scene' WHEN regexp_matches(t, '^dramatis person') THEN 'dramatis' WHEN regexp_matches(t, '^(prologue|epilogue|induction)\b') THEN 'play-section'
  WHEN regexp_matches(title, '(?i)^([ivxlcdm]+|\d+)\b[.\-\x{{2014}}: ]+\S') THEN 'numbered' ELSE 'other' END AS kind FROM b""")
def chapter_kinds(spark, sf_dir):
    p = paras(spark, sf_dir)
    before = F.element_at(F.array(*[F.lit(x) for x in _BEFORE]), (F.col("paragraph_id") % len(_BEFORE) + 1).cast("int"))
    t = p.select("doc_id", "paragraph_id", F.concat(before, "text").alias("title"))
    return t.withColumn("kind", C.chapter_kind(F.col("title"), F.lit("The Sea")))


@query(f"""SELECT doc_id, {_NORM.format(c='text')} AS norm FROM documents""")
def normalized_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.norm_dedup("text").alias("norm"))
