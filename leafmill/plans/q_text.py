"""Queries over texts, paragraphs and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill import schemas as S
from leafmill.functions import text as T
from leafmill.operators import model as M
from leafmill.operators import positions as P
from leafmill.plans import sql as Q
from leafmill.plans.registry import query, table


def paras(spark, sf_dir):
    return M.paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"))


def prefixed(spark, sf_dir):
    return P.word_prefix(M.counted(paras(spark, sf_dir)))


@query(f"SELECT doc_id, len({Q.tokens('text')})::INTEGER AS words, {Q.letters('text')}::INTEGER AS letters, len({Q.tokens('text')}) >= 50 AND {Q.letters('text')} >= 150 AS usable FROM documents")
def doc_text_viability(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").select("doc_id", T.count_words("text").alias("words"), T.letters("text").alias("letters"))
    return counts.withColumn("usable", T.usable(F.col("words"), F.col("letters")))


@query(f"""WITH {Q.COUNTED}, g AS (SELECT doc_id, count(*) AS n, sum(words) AS s, max(words) AS m FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::INTEGER AS paragraphs, coalesce(s, 0)::INTEGER AS words, coalesce(m, 0)::INTEGER AS max_paragraph_words,
  coalesce(s >= 1000 AND (n = 1 OR m > 5000 OR m / s > 0.9), false) AS collapsed FROM documents d LEFT JOIN g USING (doc_id)""")
def doc_paragraph_totals(spark, sf_dir):
    totals = M.book_totals(table(spark, sf_dir, "documents"))
    return totals.withColumn("collapsed", M.collapsed(F.col("words"), F.col("paragraphs"), F.col("max_paragraph_words")))


@query(f"""WITH {Q.PREFIXED} SELECT doc_id, paragraph_id, words, words_before,
  CASE WHEN total_words > 0 THEN floor(words_before / total_words * 100 + 0.5)::BIGINT ELSE 0 END AS percent_before FROM w""")
def paragraph_word_prefix(spark, sf_dir):
    return prefixed(spark, sf_dir).select("doc_id", "paragraph_id", "words", F.col("words_before").cast("long").alias("words_before"), P.percent(F.col("words_before"), F.col("total_words")).alias("percent_before"))


@query(f"""WITH {Q.PREFIXED} SELECT doc_id, paragraph_id, CASE WHEN total_words > 0 THEN greatest(0, least(100, floor((words_before + least(words, 2)) / total_words * 100 + 0.5)))::BIGINT ELSE 0 END AS percent_complete FROM w""")
def percent_complete(spark, sf_dir):
    return prefixed(spark, sf_dir).select("doc_id", "paragraph_id", P.percent_complete(F.col("words"), F.lit(2)).alias("percent_complete"))


@query(f"""WITH {Q.PARAGRAPHS}, {Q.CHAPTERS} SELECT p.doc_id, p.paragraph_id, ch.chapter_index FROM p ASOF LEFT JOIN ch ON p.doc_id = ch.doc_id AND p.paragraph_id >= ch.start_paragraph_id""")
def chapter_asof(spark, sf_dir):
    p = paras(spark, sf_dir)
    return P.chapter_of_paragraph(p, M.chapters_every(p))


@query(f"""WITH {Q.PREFIXED}, {Q.CHAPTERS}, l AS (SELECT chk.doc_id, chapter_index, start_paragraph_id AS s, w.words_before,
    lead(start_paragraph_id) OVER x AS nxt, lead(words_before) OVER x AS nw, w.total_words FROM chk JOIN w ON w.doc_id = chk.doc_id AND w.paragraph_id = chk.start_paragraph_id WINDOW x AS (PARTITION BY chk.doc_id ORDER BY start_paragraph_id)),
  n AS (SELECT doc_id, max(paragraph_id) AS n FROM p GROUP BY doc_id)
SELECT doc_id, chapter_index, s AS "start", coalesce(nxt, n + 1)::INTEGER AS end_exclusive, words_before, (coalesce(nw, total_words) - words_before)::BIGINT AS words FROM l JOIN n USING (doc_id)""")
def chapter_bounds(spark, sf_dir):
    p = prefixed(spark, sf_dir)
    return P.chapter_bounds(M.chapters_every(p.select("doc_id", "paragraph_id", "text")), p)


@query(f"""WITH {Q.PREFIXED}, {Q.CHAPTERS}, b AS (SELECT chk.doc_id, start_paragraph_id AS s, w.words_before AS b,
    coalesce(lead(words_before) OVER (PARTITION BY chk.doc_id ORDER BY start_paragraph_id), total_words) - words_before AS n FROM chk JOIN w ON w.doc_id = chk.doc_id AND w.paragraph_id = chk.start_paragraph_id)
SELECT w.doc_id, w.paragraph_id, CASE WHEN b.n > 0 THEN greatest(0, least(100, floor((w.words_before + least(w.words, 1) - b.b) / b.n * 100 + 0.5)))::BIGINT ELSE 0 END AS chapter_percent
FROM w ASOF LEFT JOIN b ON w.doc_id = b.doc_id AND w.paragraph_id >= b.s""")
def chapter_percent(spark, sf_dir):
    p = prefixed(spark, sf_dir)
    return P.chapter_percent(p, P.chapter_bounds(M.chapters_every(p.select("doc_id", "paragraph_id", "text")), p), F.lit(1))


@query(f"""WITH {Q.WORDS} SELECT doc_id, paragraph_id, word_index, lead(paragraph_id) OVER x AS next_paragraph_id, lead(word_index) OVER x AS next_word_index, lead(word) OVER x AS next_word, word
FROM wd WINDOW x AS (PARTITION BY doc_id ORDER BY paragraph_id, word_index)""")
def next_position(spark, sf_dir):
    return P.next_positions(M.words(paras(spark, sf_dir)))


@query(f"""WITH {Q.PARAGRAPHS} SELECT doc_id, ((paragraph_id - 1) // 50)::INTEGER AS chunk_index, count(*)::INTEGER AS paragraph_count, min(paragraph_id) AS first_id, max(paragraph_id) AS last_id FROM p GROUP BY ALL""")
def chunk_paragraphs(spark, sf_dir):
    at = F.floor((F.col("paragraph_id") - 1) / S.CHUNK_PARAGRAPHS).cast("int").alias("chunk_index")
    return paras(spark, sf_dir).groupBy("doc_id", at).agg(F.count("*").cast("int").alias("paragraph_count"), F.min("paragraph_id").alias("first_id"), F.max("paragraph_id").alias("last_id"))


@query(f"""WITH {Q.PARAGRAPHS} SELECT doc_id, ((paragraph_id - 1) // 50)::INTEGER AS chunk_index, md5(string_agg(text, chr(10) ORDER BY paragraph_id)) AS digest FROM p GROUP BY ALL""")
def chunk_contents(spark, sf_dir):
    chunks = M.chunk_paragraphs(paras(spark, sf_dir))
    return chunks.select("doc_id", "chunk_index", F.md5(F.array_join(F.transform("paragraphs", lambda x: x["text"]), "\n")).alias("digest"))


@query(f"""WITH {Q.PARAGRAPHS}, {Q.CHAPTERS} SELECT doc_id, chapter_index, title, kind,
  (CASE kind WHEN 'frontmatter' THEN 0 WHEN 'part' THEN 1 WHEN 'chapter' THEN 2 WHEN 'section' THEN 3 WHEN 'scene' THEN 4 ELSE 5 END)::INTEGER AS precedence,
  (CASE kind WHEN 'chapter' THEN 2 WHEN 'section' THEN 3 WHEN 'scene' THEN 4 ELSE 1 END)::INTEGER AS level FROM chk""")
def navigation_kinds(spark, sf_dir):
    return M.chapters_every(paras(spark, sf_dir)).select("doc_id", "chapter_index", "title", "kind", T.nav_precedence(F.col("kind")).alias("precedence"), T.nav_level(F.col("kind")).alias("level"))


@query(f"""WITH {Q.PARAGRAPHS} SELECT doc_id, paragraph_id, length(text) BETWEEN 1 AND 240 AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AS sane, lower(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS heading,
  substring(text, 1, 180) AS excerpt FROM p""")
def heading_forms(spark, sf_dir):
    return paras(spark, sf_dir).select("doc_id", "paragraph_id", T.sane_title("text").alias("sane"), T.comparable_heading("text").alias("heading"), T.excerpt("text").alias("excerpt"))


@query(f"""WITH {Q.PARAGRAPHS} SELECT doc_id, count(*) FILTER (NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AND {Q.ornaments('text')} >= 3) AS ornaments FROM p GROUP BY doc_id""")
def raw_ornaments(spark, sf_dir):
    return paras(spark, sf_dir).groupBy("doc_id").agg(F.count_if(T.raw_ornament("text")).alias("ornaments"))


@query("""SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, lower(regexp_extract(regexp_extract(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '[^/]*$'), '^.+(\\.[^.]*)$', 1)) AS ext FROM pages""")
def url_paths(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"(?s)[?#].*\z", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("ext", T.path_extname("path"))


@query("SELECT c_custkey, c_name, c_custkey % 3 = 0 AS odd, CASE WHEN c_custkey % 3 = 0 THEN regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') ELSE NULL END AS slug, sha256(c_name) AS digest FROM customer")
def name_slugs(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", (F.col("c_custkey") % 3 == 0).alias("odd"), F.when(F.col("c_custkey") % 3 == 0, T.slug("c_name")).alias("slug"), F.sha2("c_name", 256).alias("digest"))


@query(f"""WITH {Q.PARAGRAPHS}, d AS (SELECT doc_id, paragraph_id, lower(text) AS t, text FROM p) SELECT doc_id, paragraph_id,
  CASE WHEN regexp_matches(t, '^(?:page )?[0-9ivxlcdm]{{1,7}}$') THEN '<page-number>' WHEN len({Q.tokens('t')}) >= 3 THEN regexp_replace(t, '[0-9]+', '#', 'g') ELSE t END AS signature FROM d""")
def furniture_signatures(spark, sf_dir):
    return paras(spark, sf_dir).select("doc_id", "paragraph_id", T.furniture_signature("text").alias("signature"))


@query(f"""WITH {Q.PARAGRAPHS} SELECT doc_id, paragraph_id, (len(list_distinct(list_filter(regexp_split_to_array(lower(trim(text)), '{Q.SPACE}+'), lambda w: w <> ''))))::INTEGER AS distinct_words FROM p""")
def token_sets(spark, sf_dir):
    return paras(spark, sf_dir).select("doc_id", "paragraph_id", F.size(T.token_set("text")).alias("distinct_words"))


@query()
def sentences(spark, sf_dir):
    """Sentences of each paragraph; lookaround has no counterpart in the oracle's engine."""
    return paras(spark, sf_dir).select("doc_id", "paragraph_id", F.posexplode(T.sentence_split("text")).alias("sentence_index", "sentence"))


@query(f"""WITH {Q.WORDS}, e AS (SELECT *, regexp_matches(word, '[.!?][”’"'')\\]]*$') AS ends FROM wd),
s AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, paragraph_id ORDER BY word_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e)
SELECT doc_id, paragraph_id, k::INTEGER AS sentence_index, min(word_index) AS first_word, max(word_index) AS last_word FROM s GROUP BY doc_id, paragraph_id, k""")
def sentence_bounds(spark, sf_dir):
    """Ranges of words ending at a full stop, question or exclamation mark; folded inside each paragraph's array, no shuffle."""
    tokens = paras(spark, sf_dir).select("doc_id", "paragraph_id", T.tokenize("text").alias("l"))
    ends = F.filter(F.transform("l", lambda w, i: F.when(w.rlike(r"[.!?][”’\"')\]]*\z") | (i == F.size("l") - 1), i)), lambda i: i.isNotNull())
    bounded = tokens.withColumn("ends", ends).where(F.size("l") > 0)
    rows = F.transform("ends", lambda e, k: F.struct(k.alias("sentence_index"), F.when(k == 0, 0).otherwise(F.get("ends", k - 1) + 1).alias("first_word"), e.alias("last_word")))
    return bounded.select("doc_id", "paragraph_id", F.inline(rows))


@query(f"""WITH {Q.PARAGRAPHS}, b AS (SELECT doc_id, paragraph_id, CASE WHEN paragraph_id > 1 AND paragraph_id % 7 = 0 THEN 'text-ornament' END AS sb FROM p),
im AS (SELECT doc_id, (paragraph_id // 5)::INTEGER AS image_index, paragraph_id AS a FROM p WHERE paragraph_id % 5 = 0 UNION ALL SELECT DISTINCT doc_id, 1000, 0 FROM p UNION ALL SELECT DISTINCT doc_id, 1001, 100000 FROM p),
r AS (SELECT doc_id, paragraph_id, 1 AS rk, NULL::INTEGER AS image_index, 'paragraph' AS kind FROM b UNION ALL SELECT doc_id, paragraph_id, 0, NULL, 'scene-break' FROM b WHERE sb IS NOT NULL
  UNION ALL SELECT doc_id, a, 2, image_index, 'image' FROM im WHERE a < 100000)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_id, rk, image_index) - 1)::INTEGER AS row_index, kind, paragraph_id, image_index FROM r""")
def display_rows(spark, sf_dir):
    p = paras(spark, sf_dir).select("doc_id", "paragraph_id")
    breaks = p.withColumn("scene_break_before", F.when((F.col("paragraph_id") > 1) & (F.col("paragraph_id") % 7 == 0), "text-ornament"))
    some = p.where("paragraph_id % 5 = 0").select("doc_id", F.floor(F.col("paragraph_id") / 5).cast("int").alias("image_index"), F.col("paragraph_id").alias("after_paragraph_id"))
    extra = p.select("doc_id").distinct().select("doc_id", F.inline(F.expr("array(named_struct('image_index', 1000, 'after_paragraph_id', 0), named_struct('image_index', 1001, 'after_paragraph_id', 100000))")))
    return P.display_rows(breaks, some.unionByName(extra))


@query(f"""WITH {Q.PARAGRAPHS}, {Q.CHAPTERS} SELECT p.doc_id, p.paragraph_id, kind IN ('chapter', 'part') AND trim(regexp_replace(lower(p.text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) = trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS duplicate
FROM p JOIN chk ON p.doc_id = chk.doc_id AND p.paragraph_id = chk.start_paragraph_id""")
def duplicate_headings(spark, sf_dir):
    p = paras(spark, sf_dir)
    return P.duplicate_headings(p, M.chapters_every(p))


@query(f"""WITH {Q.PARAGRAPHS}, n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id), x AS (SELECT doc_id, paragraph_id AS pos, text AS title, (paragraph_id * 2 - 3)::INTEGER AS s FROM p),
k AS (SELECT doc_id, pos, {Q.norm('title')} AS title, greatest(1, least(greatest(n, 1), s))::INTEGER AS start_paragraph_id FROM x JOIN n USING (doc_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(title), start_paragraph_id ORDER BY pos) AS r FROM k WHERE length(title) BETWEEN 1 AND 240), q AS (SELECT *, {Q.nav_kind('title')} AS kind FROM f WHERE r = 1)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start_paragraph_id, CASE kind WHEN 'frontmatter' THEN 0 WHEN 'part' THEN 1 WHEN 'chapter' THEN 2 WHEN 'section' THEN 3 WHEN 'scene' THEN 4 ELSE 5 END, pos) - 1)::INTEGER AS chapter_index,
  title, start_paragraph_id, kind, (CASE kind WHEN 'chapter' THEN 2 WHEN 'section' THEN 3 WHEN 'scene' THEN 4 ELSE 1 END)::INTEGER AS level FROM q""")
def dedup_chapters(spark, sf_dir):
    p = paras(spark, sf_dir)
    chapters = p.select("doc_id", F.col("paragraph_id").alias("pos"), F.col("text").alias("title"), (F.col("paragraph_id") * 2 - 3).alias("start_paragraph_id"))
    return M.dedup_chapters(chapters, p.groupBy("doc_id").agg(F.count("*").cast("int").alias("paragraphs")), "doc_id")


@query(f"""WITH {Q.PARAGRAPHS} SELECT doc_id, count(*) AS chapters, count(DISTINCT paragraph_id // 4) AS distinct_starts, count(*) >= 4 AND count(DISTINCT paragraph_id // 4) / count(*) < 0.4 AS collapsed FROM p GROUP BY doc_id""")
def collapsed_starts(spark, sf_dir):
    p = paras(spark, sf_dir).select("doc_id", F.floor(F.col("paragraph_id") / 4).alias("start_paragraph_id"))
    return M.collapsed_starts(p, "doc_id")


@query("SELECT doc_id, lang, quantile_disc(n_chars, 0.5) OVER (PARTITION BY lang) AS p50 FROM documents")
def length_against_median(spark, sf_dir):
    """Each document beside its language's median length; the aggregate is small and joined back, so no language is gathered."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    mid = d.groupBy(F.col("lang").alias("l")).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n_chars)").cast("long").alias("p50"))
    return d.join(mid, F.col("lang").eqNullSafe(F.col("l"))).select("doc_id", "lang", "p50")
