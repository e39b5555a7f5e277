"""Queries over sources, geometry and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import geometry as G
from leafmill.plans import sql as Q
from leafmill.plans.q_text import paras
from leafmill.plans.registry import query, table
from leafmill.sources import epub, files, html
from leafmill.streaming import jobs


@query()
def page_blocks(spark, sf_dir):
    """Paragraphs, headings, images and anchors of every page; tested against fixed pages."""
    return html.html_blocks(table(spark, sf_dir, "pages"))


@query()
def page_totals(spark, sf_dir):
    rows = html.html_blocks(table(spark, sf_dir, "pages"))
    words = F.sum(F.when(F.col("kind") == "paragraph", T.count_words("text")).otherwise(0))
    return rows.groupBy("page_id").agg(words.alias("words"), F.count_if(F.col("kind") == "paragraph").alias("paragraphs"), F.count_if(F.col("kind") == "heading").alias("headings"))


@query("""SELECT p_partkey, CASE WHEN starts_with(h, '255044462D') THEN 'pdf' WHEN starts_with(h, '504B') THEN 'epub' END AS format, CASE WHEN NOT (starts_with(h, '255044462D') OR starts_with(h, '504B')) THEN 'Unsupported format' WHEN p_partkey % 2 = 0 AND starts_with(h, '2550') THEN 'File extension does not match its content: pdf' WHEN p_partkey % 2 = 1 AND starts_with(h, '504B') THEN 'File extension does not match its content: epub' END AS error
FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '255044462D312E34' WHEN 1 THEN '504B0304' ELSE '3C68746D6C' END AS h FROM part)""")
def file_formats(spark, sf_dir):
    k = F.col("p_size") % 3
    content = F.unhex(F.when(k == 0, "255044462D312E34").when(k == 1, "504B0304").otherwise("3C68746D6C"))
    name = F.when(F.col("p_partkey") % 2 == 0, "Book.EPUB").otherwise("book.pdf")
    return table(spark, sf_dir, "part").select("p_partkey", files.detect_format(content).alias("format"), files.format_error(content, name).alias("error"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 'Unsupported format' WHEN l_extendedprice * 4000 > 157286400 THEN 'File too large' END AS error FROM lineitem")
def source_errors(spark, sf_dir):
    name = F.when(F.col("l_partkey") % 3 == 0, "a.txt").otherwise("a.PDF")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", files.validate_source(name, F.col("l_extendedprice") * 4000).alias("error"))


@query("""WITH f AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b, c_custkey AS size FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT a AS path, 1 AS depth, count(*) AS books, sum(size)::BIGINT AS bytes FROM f GROUP BY a UNION ALL SELECT a || '/' || b, 2, count(*), sum(size)::BIGINT FROM f GROUP BY a, b""")
def folder_tree(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("//n"), F.col("n_nationkey").cast("string"), F.lit("\\book.epub"))
    return files.folder_tree(c.select(path.alias("path"), F.col("c_custkey").alias("size")))


_TOC = f"""WITH {Q.PARAGRAPHS}, an AS (SELECT doc_id, CASE WHEN paragraph_id % 2 = 0 THEN 'a.xhtml' ELSE 'B.xhtml' END AS path, 'Id' || (paragraph_id % 9) AS fragment, paragraph_id, paragraph_id AS pos FROM p),
fs AS (SELECT doc_id, path, min(paragraph_id) AS paragraph_id FROM an GROUP BY ALL), n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
toc AS (SELECT doc_id, k AS ord, CASE k % 3 WHEN 0 THEN 'a.xhtml' WHEN 1 THEN 'B.xhtml' ELSE 'gone.xhtml' END AS path, CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN 'id' || (k % 9) ELSE 'Id' || (k % 11) END AS fragment FROM n, (SELECT unnest(range(12)) AS k)),
ex AS (SELECT doc_id, path, fragment, arg_min(paragraph_id, pos) AS x FROM an GROUP BY ALL), lo AS (SELECT doc_id, lower(path) AS path, lower(fragment) AS fragment, arg_min(paragraph_id, pos) AS x FROM an GROUP BY ALL)
SELECT toc.doc_id AS book, ord::INTEGER AS ord, greatest(1, least(n.n, coalesce(CASE WHEN toc.fragment <> '' THEN coalesce(ex.x, lo.x) END, fs.paragraph_id))) AS start_paragraph_id FROM toc JOIN n ON n.doc_id = toc.doc_id
  LEFT JOIN ex ON ex.doc_id = toc.doc_id AND ex.path = toc.path AND ex.fragment = toc.fragment LEFT JOIN lo ON lo.doc_id = toc.doc_id AND lo.path = lower(toc.path) AND lo.fragment = lower(toc.fragment) LEFT JOIN fs ON fs.doc_id = toc.doc_id AND fs.path = toc.path
WHERE coalesce(CASE WHEN toc.fragment <> '' THEN coalesce(ex.x, lo.x) END, fs.paragraph_id) IS NOT NULL"""


@query(_TOC)
def toc_targets(spark, sf_dir):
    p = paras(spark, sf_dir).select(F.col("doc_id").alias("book"), "paragraph_id")
    anchors = p.select("book", F.when(F.col("paragraph_id") % 2 == 0, "a.xhtml").otherwise("B.xhtml").alias("path"), F.concat(F.lit("Id"), (F.col("paragraph_id") % 9).cast("string")).alias("fragment"), "paragraph_id", F.col("paragraph_id").alias("pos"))
    counts = p.groupBy("book").agg(F.count("*").alias("n"))
    k = F.col("ord")
    toc = counts.select("book", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("ord")).select("book", "ord", F.lit("t").alias("title"), F.when(k % 3 == 0, "a.xhtml").when(k % 3 == 1, "B.xhtml").otherwise("gone.xhtml").alias("path"), F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("id"), (k % 9).cast("string"))).otherwise(F.concat(F.lit("Id"), (k % 11).cast("string"))).alias("fragment"))
    starts = anchors.groupBy("book", "path").agg(F.min("paragraph_id").alias("paragraph_id"))
    return epub.toc_targets(toc, anchors, starts, counts).where("start_paragraph_id IS NOT NULL").select("book", "ord", F.col("start_paragraph_id").cast("long").alias("start_paragraph_id"))


@query(f"""WITH {Q.PARAGRAPHS}, f AS (SELECT doc_id, count(*) AS n, count(DISTINCT paragraph_id // 3) AS nav_s, count(*) FILTER (paragraph_id % 5 = 0) AS ncx_n FROM p GROUP BY doc_id)
SELECT doc_id AS book, CASE WHEN NOT (n >= 4 AND nav_s / n < 0.4) AND (ncx_n <= 1 OR nav_s >= ceil(ncx_n / 2)) THEN 'nav' WHEN ncx_n > 0 AND (NOT (n >= 4 AND nav_s / n < 0.4) OR ncx_n >= 2) THEN 'ncx' ELSE 'headings' END AS source FROM f""")
def chapter_sources(spark, sf_dir):
    p = paras(spark, sf_dir).select(F.col("doc_id").alias("book"), F.col("paragraph_id").alias("ord"))
    nav = p.select("book", F.lit("nav").alias("source"), "ord", F.floor(F.col("ord") / 3).alias("start_paragraph_id"))
    ncx = p.where("ord % 5 = 0").select("book", F.lit("ncx").alias("source"), "ord", F.col("ord").cast("long").alias("start_paragraph_id"))
    heads = p.where("ord = 1").select("book", F.lit("headings").alias("source"), "ord", F.col("ord").cast("long").alias("start_paragraph_id"))
    return epub.choose_source(nav.unionByName(ncx).unionByName(heads), p.select("book").distinct()).select("book", "source")


_LINES = """ln AS (SELECT l_orderkey AS book_id, (l_linenumber % 2)::BIGINT AS page, (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber AS line_id, l_quantity * 10 AS x_min, l_quantity * 10 + l_discount * 3000 AS x_max, l_extendedprice AS baseline FROM lineitem)"""


def _lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("book_id"), (F.col("l_linenumber") % 2).cast("long").alias("page"), ((F.col("l_partkey") * 100000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("line_id"), (F.col("l_quantity") * 10).alias("x_min"), (F.col("l_quantity") * 10 + F.col("l_discount") * 3000).alias("x_max"), F.col("l_extendedprice").alias("baseline"))


@query(f"""WITH {_LINES}, s AS (SELECT *, CASE WHEN x_max < 262.5 THEN 1 WHEN x_min > 237.5 THEN 2 ELSE 0 END AS side FROM ln), c AS (SELECT *, count(*) OVER g AS n, count(*) FILTER (side = 1) OVER g AS nl, count(*) FILTER (side = 2) OVER g AS nr FROM s WINDOW g AS (PARTITION BY book_id, page)),
t AS (SELECT *, n >= 4 AND nl >= 3 AND nr >= 3 AND n - nl - nr <= n * 0.3 AS two, coalesce(sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, page ORDER BY baseline, x_min, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS band FROM c)
SELECT book_id, page, line_id, (CASE WHEN two THEN side ELSE 0 END)::INTEGER AS col, (row_number() OVER (PARTITION BY book_id, page ORDER BY CASE WHEN two THEN band ELSE 0 END, CASE WHEN two AND side = 0 THEN 3 WHEN two THEN side ELSE 0 END, baseline, x_min, line_id) - 1)::INTEGER AS line_order FROM t""")
def column_order(spark, sf_dir):
    return G.column_order(_lines(spark, sf_dir), 500.0, 4)


@query(f"""WITH {Q.PARAGRAPHS}, g AS (SELECT doc_id AS book_id, ((paragraph_id - 1) // 8)::BIGINT AS page, paragraph_id, text, ((paragraph_id - 1) % 8) * 12.0 + CASE WHEN (paragraph_id - 1) % 8 >= 4 THEN 20 ELSE 0 END AS baseline FROM p),
s AS (SELECT *, baseline - lag(baseline) OVER (PARTITION BY book_id, page ORDER BY paragraph_id) AS step FROM g), m AS (SELECT book_id, page, median(step) AS typical FROM s GROUP BY ALL),
b AS (SELECT s.*, step IS NULL OR step > 1.5 * typical AS begins FROM s JOIN m USING (book_id, page)), i AS (SELECT *, sum(begins::INT) OVER (PARTITION BY book_id, page ORDER BY paragraph_id) AS island FROM b)
SELECT book_id, page, island::BIGINT AS island, count(*) AS lines FROM i GROUP BY ALL""")
def line_islands(spark, sf_dir):
    p = paras(spark, sf_dir)
    at = (F.col("paragraph_id") - 1) % 8
    lines = p.select(F.col("doc_id").alias("book_id"), F.floor((F.col("paragraph_id") - 1) / 8).alias("page"), F.col("paragraph_id").alias("line_order"), F.lit(1).alias("col"), (at * 12.0 + F.when(at >= 4, 20).otherwise(0)).alias("baseline"), F.lit(10.0).alias("font_size"), "text")
    return G.line_paragraphs(lines).select("book_id", "page", "island", "lines")


@query()
def gap_clusters(spark, sf_dir):
    """Greedy clusters with running medians; tested against a plain fold."""
    gaps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.lit(0).alias("page"), F.col("l_quantity").alias("gap"))
    return G.gap_clusters(gaps, 3.0)


@query()
def oversized_paragraphs(spark, sf_dir):
    """Long paragraphs in pieces; lookaround has no counterpart in the oracle's engine."""
    p = paras(spark, sf_dir)
    return p.select("doc_id", "paragraph_id", F.posexplode(G.oversized_split(F.col("text"))).alias("piece", "text"))


@query("""WITH c AS (SELECT o_custkey AS book_id, o_orderpriority AS key, o_orderkey AS start, o_totalprice / 100000 AS prominence FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY book_id, key ORDER BY prominence DESC, start DESC) AS n FROM c),
s AS (SELECT *, max(CASE WHEN n = 2 THEN prominence END) OVER (PARTITION BY book_id, key) AS second, max(prominence) OVER (PARTITION BY book_id, key) AS best FROM r) SELECT book_id, key, start, prominence FROM s WHERE n = 1 OR NOT (second IS NULL OR best >= second + 0.12)""")
def heading_dedup(spark, sf_dir):
    return G.heading_dedup(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderpriority").alias("key"), F.col("o_orderkey").alias("start"), (F.col("o_totalprice") / 100000).alias("prominence")))


@query("""WITH h AS (SELECT o_custkey AS book_id, o_orderkey AS start, (o_orderkey // 400)::INTEGER AS ord FROM orders), s AS (SELECT *, ord < lag(ord) OVER (PARTITION BY book_id ORDER BY start) AS falls FROM h)
SELECT book_id, count(DISTINCT ord) >= 3 AND NOT coalesce(bool_or(falls), false) AND max(start) - min(start) >= 200 AS reliable FROM s GROUP BY book_id""")
def numbered_sequences(spark, sf_dir):
    h = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("start"), F.floor(F.col("o_orderkey") / 400).cast("int").alias("ord"))
    return G.numbered_ok(h, h.select("book_id").distinct().withColumn("paragraphs", F.lit(1000)))


_HKEY = r"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(f"""WITH {Q.PARAGRAPHS}, h AS (SELECT doc_id, paragraph_id, {_HKEY.format(c='text')} AS k FROM p), o AS (SELECT doc_id, paragraph_id AS ord, {_HKEY.format(c="CASE WHEN paragraph_id % 4 = 1 THEN text ELSE text || ' one more' END")} AS k FROM p),
x AS (SELECT o.doc_id, ord, h.paragraph_id, CASE WHEN o.k = h.k THEN 2.0 ELSE len(list_intersect(string_split(o.k, ' '), string_split(h.k, ' '))) / len(list_distinct(string_split(o.k, ' ') || string_split(h.k, ' '))) END AS s FROM o JOIN h ON o.doc_id = h.doc_id WHERE o.k <> '' AND h.k <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY s DESC, paragraph_id) AS n FROM x WHERE s >= 0.8)
SELECT o.doc_id AS book_id, o.ord, r.paragraph_id FROM o LEFT JOIN r ON r.doc_id = o.doc_id AND r.ord = o.ord AND r.n = 1""")
def outline_headings(spark, sf_dir):
    p = paras(spark, sf_dir).withColumnRenamed("doc_id", "book_id")
    title = F.when(F.col("paragraph_id") % 4 == 1, F.col("text")).otherwise(F.concat("text", F.lit(" one more")))
    return G.outline_match(p.select("book_id", F.col("paragraph_id").alias("ord"), title.alias("title")), p.select("book_id", "paragraph_id", F.col("text").alias("title")))


_NORM = r"lower(trim(regexp_replace(strip_accents(nfc_normalize({c})), '\s+', ' ', 'g')))"


@query(rf"""WITH {Q.PARAGRAPHS}, t AS (SELECT doc_id, paragraph_id, text, {_NORM.format(c='text')} AS k, paragraph_id % 2 AS file, count(*) OVER (PARTITION BY doc_id) AS total FROM p),
e AS (SELECT doc_id, paragraph_id AS ord, CASE paragraph_id % 5 WHEN 0 THEN split_part(text, ' ', 1) WHEN 1 THEN array_to_string(string_split(text, ' ')[1:3], ' ') WHEN 2 THEN (paragraph_id % 9) || '. ' || text WHEN 3 THEN split_part(text, ' ', 2) ELSE text END AS title, paragraph_id // 2 % 3 AS file, CASE WHEN paragraph_id % 7 = 0 THEN 'front' WHEN paragraph_id % 7 = 1 THEN 'other' WHEN paragraph_id % 7 = 2 THEN 'letter' WHEN paragraph_id % 7 = 3 THEN 'part' ELSE 'chapter' END AS kind FROM p),
f AS (SELECT *, {_NORM.format(c='title')} AS k FROM e),
s AS (SELECT f.doc_id, f.ord, t.paragraph_id, CASE WHEN f.file = t.file THEN 90 ELSE 0 END + CASE WHEN t.k = f.k THEN 55 ELSE 0 END + CASE WHEN starts_with(t.k, f.k || ' ') THEN 25 ELSE 0 END + CASE WHEN length(t.text) <= length(f.title) + 24 THEN 10 ELSE 0 END
  + CASE WHEN t.paragraph_id <= greatest(20, floor(t.total * 0.05)) THEN -30 ELSE 0 END + CASE WHEN kind IN ('letter', 'chapter') THEN 20 WHEN kind = 'other' THEN 10 WHEN kind = 'front' THEN -60 ELSE 0 END + CASE WHEN f.file = t.file AND t.file > 0 THEN 10 ELSE 0 END AS score
  FROM f JOIN t ON f.doc_id = t.doc_id AND (t.k = f.k OR starts_with(t.k, f.k || ' ') OR t.k = f.k || '.' OR t.k = f.k || ',' OR (length(t.k) < length(f.k) + 15 AND contains(t.k, f.k)) OR (regexp_matches(f.k, '^\d+\.\s*.+$') AND (t.k = regexp_extract(f.k, '^(\d+)\.', 1) OR t.k = 'chapter ' || regexp_extract(f.k, '^(\d+)\.', 1) OR t.k = regexp_extract(f.k, '^\d+\.\s*(.+)$', 1)))) WHERE length(f.k) BETWEEN 1 AND 240 AND t.k <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY score DESC, paragraph_id) AS n FROM s) SELECT doc_id AS book_id, ord, score::INTEGER AS score, paragraph_id FROM r WHERE n = 1""")
def toc_scored_matches(spark, sf_dir):
    p = paras(spark, sf_dir).withColumnRenamed("doc_id", "book_id")
    k = F.col("paragraph_id")
    total = p.groupBy("book_id").agg(F.count("*").alias("total"))
    paragraphs = p.withColumns({"file": k % 2, "spine": k % 2}).join(total, "book_id")
    words = F.split("text", " ")
    title = F.when(k % 5 == 0, words[0]).when(k % 5 == 1, F.array_join(F.slice(words, 1, 3), " ")).when(k % 5 == 2, F.concat((k % 9).cast("string"), F.lit(". "), "text")).when(k % 5 == 3, F.coalesce(F.get(words, F.lit(1)), F.lit(""))).otherwise(F.col("text"))
    kind = F.when(k % 7 == 0, "front").when(k % 7 == 1, "other").when(k % 7 == 2, "letter").when(k % 7 == 3, "part").otherwise("chapter")
    toc = p.select("book_id", k.alias("ord"), title.alias("title"), (F.floor(k / 2) % 3).cast("int").alias("file"), kind.alias("kind"))
    return G.toc_scored_match(toc, paragraphs)


@query("""WITH c AS (SELECT o_custkey AS book_id, (o_orderkey % 3)::INTEGER AS start, o_orderkey AS pos, o_orderpriority AS title, length(o_orderstatus || o_orderpriority) % 4 AS score FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY book_id, start ORDER BY score DESC, length(title) DESC, pos) AS n FROM c) SELECT book_id, start, pos, title, score FROM r WHERE n = 1""")
def best_per_start(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return G.best_per_start(o.select(F.col("o_custkey").alias("book_id"), (F.col("o_orderkey") % 3).cast("int").alias("start"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("title"), (F.length(F.concat("o_orderstatus", "o_orderpriority")) % 4).cast("long").alias("score")))


@query(f"""WITH {Q.PARAGRAPHS}, x AS (SELECT doc_id, paragraph_id, (CASE WHEN paragraph_id % 4 = 0 THEN 'Chapter ' WHEN paragraph_id % 4 = 1 THEN 'part ' WHEN paragraph_id % 4 = 2 THEN 'Section ' ELSE 'Page ' END) || (paragraph_id % 30) || ': x' AS t FROM p)
SELECT doc_id, paragraph_id, CASE WHEN paragraph_id % 4 < 3 THEN lower(split_part(t, ' ', 1)) END AS family, CASE WHEN paragraph_id % 4 < 3 THEN (paragraph_id % 30)::INTEGER END AS "order" FROM x""")
def structural_markers(spark, sf_dir):
    k = F.col("paragraph_id")
    title = F.concat(F.when(k % 4 == 0, "Chapter ").when(k % 4 == 1, "part ").when(k % 4 == 2, "Section ").otherwise("Page "), (k % 30).cast("string"), F.lit(": x"))
    family, order = G.structural_marker(title)
    return paras(spark, sf_dir).select("doc_id", "paragraph_id", family.alias("family"), order.alias("order"))




@query("""WITH e AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 2 HOUR, true) AS b FROM events), s AS (SELECT *, sum(b::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
SELECT user_id, min(ts) AS burst_start, arg_max(value, (ts, event_id)) AS value, count(*) AS events FROM s GROUP BY user_id, k""")
def progress_bursts(spark, sf_dir):
    """The batch form of the progress debounce, bursts closed by two quiet hours."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "value")
    return jobs.progress_debounce(e, quiet="2 hours").withColumn("burst_start", F.col("burst_start").cast("timestamp_ntz"))


@query()
def scroll_intents(spark, sf_dir):
    """Intents with values as scroll positions; tested against the streaming form."""
    e = table(spark, sf_dir, "events")
    return jobs.scroll_intents_batch(e.select(F.col("user_id").cast("string").alias("key"), (F.col("event_id") * 37).alias("ms"), F.col("event_id").alias("seq"), F.col("value").alias("top")))


