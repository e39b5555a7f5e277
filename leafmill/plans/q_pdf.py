"""Queries over positioned text: paragraphs of documents as drafts with lines, items of orders as lines and images of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import pdf_text as D
from leafmill.plans import sql as Q
from leafmill.plans.q_text import paras
from leafmill.plans.registry import query, table

_ENDS = r"[.!?\x{2026}:\x{201D}\x{2019})]$"
_BEGINS = r"^[\p{Lu}\x{201C}\x{2018}\[]"
_MARKS = r"[*\x{2042}\x{2022}\x{25C6}\x{25C7}\x{25CA}\x{2766}\x{2767}\x{00B7}]"


def _joined(parts: str) -> str:
    """SQL: a list of texts joined; chr(1) tells the seams from blanks inside."""
    clean = f"list_filter(list_transform({parts}, lambda q: {Q.norm('q')}), lambda q: q <> '')"
    return rf"replace(regexp_replace(array_to_string({clean}, chr(1)), '(\p{{L}})[-\x{{2010}}]\x01(\p{{Ll}})', '\1\2', 'g'), chr(1), ' ')"


def _lines(texts, base, col):
    """Lines of 12 points, one below the other."""
    return F.transform(texts, lambda x, i: F.struct(x.alias("text"), col.cast("int").alias("col"), (base + i * 12).cast("double").alias("baseline"), F.lit(10.0).alias("font_size"), F.lit(0.0).alias("x_min"), F.lit(100.0).alias("x_max")))


_GAPS = """(SELECT book_id, page, median(gap) AS typical FROM (SELECT *, ay - lag(ay) OVER (PARTITION BY book_id, page, col ORDER BY ay) AS gap FROM ln) WHERE gap > 0 AND gap < 30 GROUP BY ALL)"""
_HEADS = f"""{Q.PARAGRAPHS}, d AS (SELECT doc_id AS book_id, (paragraph_id - 1) // 4 AS page, (paragraph_id - 1) % 4 AS para, CASE WHEN paragraph_id % 7 IN (0, 3) THEN 'strong' WHEN paragraph_id % 7 IN (1, 2) THEN 'typographic' END AS heading, CASE WHEN paragraph_id % 5 = 0 THEN 'Chapter ' || text ELSE text END AS text, string_split(text, ', ') AS lt, (paragraph_id % 11 = 0)::INT AS col, (paragraph_id - 1) % 4 * 30.0 AS b FROM p),
ln AS (SELECT book_id, page, col, b + 12 * unnest(range(0, len(lt))) AS ay FROM d)"""


def _drafts(spark, sf_dir):
    k = F.col("paragraph_id")
    p = paras(spark, sf_dir)
    heading = F.when((k % 7).isin(0, 3), "strong").when((k % 7).isin(1, 2), "typographic")
    para = (k - 1) % 4
    return p.select(F.col("doc_id").alias("book_id"), F.floor((k - 1) / 4).alias("page"), para.alias("para"), heading.alias("heading"), F.when(k % 5 == 0, F.concat(F.lit("Chapter "), "text")).otherwise(F.col("text")).alias("text"), _lines(F.split("text", ", "), para * 30, k % 11 == 0).alias("lines"))


@query(rf"""WITH {_HEADS}, g AS {_GAPS}, s AS (SELECT d.*, typical, lag(heading) OVER w AS ph, lag(col) OVER w AS pc, lag(b + 12 * (len(lt) - 1)) OVER w AS pb FROM d LEFT JOIN g USING (book_id, page) WINDOW w AS (PARTITION BY book_id, page ORDER BY para)),
j AS (SELECT *, coalesce(ph IS NOT NULL AND heading IS NOT NULL AND pc = col AND b - pb <= typical * 2.2 + 2 AND NOT regexp_matches(text, '(?i)^(?:chapter|book|part|section|prologue|epilogue|appendix)\b|^(?:\p{{N}}{{1,3}}(?:\.\p{{N}}{{1,3}})*|[ivxlcdm]+)[.)]?\s+'), false) AS joins FROM s),
i AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY book_id, page ORDER BY para) AS island FROM j)
SELECT book_id, page, min(para) AS para, CASE WHEN bool_or(heading = 'strong') THEN 'strong' ELSE arg_min(heading, para) END AS heading, CASE WHEN count(*) = 1 THEN any_value(text) ELSE {_joined('list(text ORDER BY para)')} END AS text, sum(len(lt))::INTEGER AS lines FROM i GROUP BY book_id, page, island""")
def merged_headings(spark, sf_dir):
    d = _drafts(spark, sf_dir)
    lines = d.select("book_id", "page", F.explode("lines").alias("l")).select("book_id", "page", "l.col", "l.baseline", "l.font_size")
    return D.merge_headings(d, D.typical_gaps(lines)).withColumn("lines", F.size("lines"))


_PAGES = f"""{Q.PARAGRAPHS}, d AS (SELECT doc_id AS book_id, paragraph_id AS k, paragraph_id - CASE WHEN paragraph_id % 10 < 4 THEN paragraph_id % 10 ELSE 0 END AS page, CASE WHEN paragraph_id % 13 = 0 THEN 'strong' END AS heading,
  CASE WHEN paragraph_id % 4 < 3 THEN lower(substring(text, 1, 1)) || substring(text, 2) ELSE text END AS a FROM p), x AS (SELECT *, CASE WHEN k % 3 = 0 THEN a || '-' WHEN k % 3 = 1 THEN substring(a, 1, length(a) - 1) || ',' ELSE a END AS text FROM d)"""


@query(rf"""WITH {_PAGES}, s AS (SELECT *, lag(text) OVER w AS e, lag(page) OVER w AS pp, lag(heading) OVER w AS ph FROM x WINDOW w AS (PARTITION BY book_id ORDER BY k)),
j AS (SELECT *, coalesce(pp < page AND ph IS NULL AND heading IS NULL AND CASE WHEN regexp_matches(e, '[-\x{{2010}}\x{{2011}}]$') THEN regexp_matches(text, '^\p{{Ll}}') ELSE regexp_matches(e, '[,;:]$') OR (NOT regexp_matches(e, '{_ENDS}') AND regexp_matches(text, '^[\p{{Ll}}\x{{201C}}\x{{2018}}]')) END, false) AS joins FROM s),
i AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY book_id ORDER BY k) AS island FROM j)
SELECT book_id, min(page) AS page, min(k) AS para, CASE WHEN count(*) = 1 THEN any_value(text) ELSE {_joined('list(text ORDER BY k)')} END AS text, count(*)::INTEGER AS parts FROM i GROUP BY book_id, island""")
def merged_pages(spark, sf_dir):
    k = F.col("para")
    p = paras(spark, sf_dir).select(F.col("doc_id").alias("book_id"), F.col("paragraph_id").alias("para"), "text")
    a = F.when(k % 4 < 3, F.concat(F.lower(F.substring("text", 1, 1)), F.substring("text", F.lit(2), F.length("text")))).otherwise(F.col("text"))
    d = p.withColumn("text", a).withColumn("text", F.when(k % 3 == 0, F.concat("text", F.lit("-"))).when(k % 3 == 1, F.concat(F.substring("text", F.lit(1), F.length("text") - 1), F.lit(","))).otherwise(F.col("text")))
    d = d.select("book_id", (k - F.when(k % 10 < 4, k % 10).otherwise(0)).alias("page"), "para", F.when(k % 13 == 0, "strong").alias("heading"), "text", F.array(F.struct(F.lit("").alias("text"))).alias("lines"))
    return D.merge_pages(d).select("book_id", "page", "para", "text", F.size("lines").alias("parts"))


def _ornament(c: str) -> str:
    t = Q.norm(c)
    return rf"(NOT regexp_matches({t}, '[\p{{L}}\p{{N}}]') AND (regexp_matches({t}, '^[\x{{2042}}\x{{2766}}\x{{2767}}]$') OR (length(regexp_replace({t}, '{_MARKS.replace('[', '[^', 1)}', '', 'g')) >= 3 AND regexp_replace({t}, '[\s*\x{{2042}}\x{{2022}}\x{{25C6}}\x{{25C7}}\x{{25CA}}\x{{2766}}\x{{2767}}\x{{00B7}}\x{{2014}}\x{{2013}}_-]', '', 'g') = '')))"


def _enough(c: str, n: int = 3) -> str:
    return f"len({Q.tokens(c)}) >= {n}"


_SCENES = rf"""{Q.PARAGRAPHS}, d0 AS (SELECT doc_id AS book_id, paragraph_id AS id, (paragraph_id - 1) // 6 AS page, CASE WHEN paragraph_id % 9 = 0 THEN 'strong' END AS heading, text AS t0, string_split(text, ', ') AS l0, paragraph_id % 8 AS m, (paragraph_id - 1) % 6 * 40.0 AS b FROM p),
d AS (SELECT *, CASE m WHEN 3 THEN ['* * *'] WHEN 5 THEN list_prepend('***', l0) WHEN 6 THEN list_append(l0, '⁂') WHEN 2 THEN list_concat([l0[1], '• • •'], l0[2:]) ELSE l0 END AS lt FROM d0),
e AS (SELECT *, CASE WHEN m IN (2, 3, 5, 6) THEN array_to_string(lt, ' ') WHEN m = 7 THEN t0 || ' ' || repeat('* ', 16) || t0 ELSE t0 END AS text FROM d),
ln AS (SELECT book_id, page, 0 AS col, b + 12 * unnest(range(0, len(lt))) AS ay FROM e),
o AS (SELECT *, {_ornament('text')} AS alone, list_transform(lt, lambda x: {_ornament('x')}) AS orn, regexp_extract(text, '(?:\s*{_MARKS}){{16,}}\s*') AS run FROM e),
f AS (SELECT *, min(id) FILTER (NOT alone) OVER (PARTITION BY book_id) AS fk, max(id) OVER (PARTITION BY book_id) AS li, coalesce(list_position(orn, true), 0) AS ip FROM o),
t AS (SELECT *, {_joined('lt[2:]')} AS tail, {_joined('lt[1:len(lt) - 1]')} AS front, {_joined('lt[1:ip - 1]')} AS above, {_joined('lt[ip + 1:]')} AS below, CASE WHEN run <> '' THEN strpos(text, run) END AS ra FROM f),
r AS (SELECT *, {Q.norm('substring(text, 1, ra - 1)')} AS rx, {Q.norm('substring(text, ra + length(run))')} AS ry FROM t),
k AS (SELECT *, CASE WHEN alone THEN 'ornament' WHEN orn[1] AND len(lt) > 1 AND id > fk AND {_enough('tail')} THEN 'first' WHEN orn[len(lt)] AND len(lt) > 1 AND id < li AND {_enough('front')} THEN 'last'
  WHEN ip > 1 AND ip < len(lt) AND {_enough('above')} AND {_enough('below')} THEN 'lines' WHEN ra IS NOT NULL AND {_enough('rx')} AND {_enough('ry')} AND regexp_matches(rx, '{_ENDS}') AND regexp_matches(ry, '{_BEGINS}') THEN 'run' ELSE 'plain' END AS kind FROM r),
q AS (SELECT *, CASE kind WHEN 'first' THEN tail WHEN 'last' THEN front WHEN 'lines' THEN below WHEN 'run' THEN ry ELSE text END AS ot, b + 12 * (len(lt) - CASE WHEN kind = 'last' THEN 2 ELSE 1 END) AS eb, len(lt) - CASE kind WHEN 'first' THEN 1 WHEN 'last' THEN 1 WHEN 'lines' THEN ip ELSE 0 END AS ol FROM k),
v AS (SELECT q.*, typical, lag(kind) OVER w AS pk, lag(id > fk) OVER w AS po, lag(heading) OVER w AS ph, lag(q.page) OVER w AS pp, lag(eb) OVER w AS pe, lag(ot) OVER w AS pt FROM q LEFT JOIN {_GAPS} g USING (book_id, page) WINDOW w AS (PARTITION BY book_id ORDER BY id)),
z AS (SELECT *, coalesce((pk = 'ornament' AND po) OR pk = 'last', false) AS pending, coalesce(heading IS NULL AND ph IS NULL AND pk <> 'ornament' AND pp = page AND b - pe >= greatest(typical * 2.2, typical + 8) AND {_enough('pt', 8)} AND {_enough('text', 8)} AND regexp_matches(pt, '{_ENDS}') AND regexp_matches(text, '{_BEGINS}'), false) AS space FROM v)"""


@query(f"""WITH {_SCENES} SELECT book_id, id, (kind IN ('lines', 'run'))::INTEGER AS part, ot AS text, ol::INTEGER AS lines, CASE WHEN kind IN ('first', 'lines', 'run') THEN 'text-ornament' WHEN kind = 'plain' AND pending THEN 'text-ornament' WHEN kind = 'plain' AND space THEN 'whitespace' END AS scene FROM z WHERE kind <> 'ornament'
UNION ALL SELECT book_id, id, 0, CASE WHEN kind = 'lines' THEN above ELSE rx END, CASE WHEN kind = 'lines' THEN ip - 1 ELSE len(lt) END, NULL FROM z WHERE kind IN ('lines', 'run')""")
def printed_scene_breaks(spark, sf_dir):
    k = F.col("paragraph_id")
    p = paras(spark, sf_dir)
    cut = F.split("text", ", ")
    m = k % 8
    lt = F.when(m == 3, F.array(F.lit("* * *"))).when(m == 5, F.concat(F.array(F.lit("***")), cut)).when(m == 6, F.concat(cut, F.array(F.lit("⁂")))).when(m == 2, F.concat(F.slice(cut, 1, 1), F.array(F.lit("• • •")), F.slice(cut, F.lit(2), F.size(cut)))).otherwise(cut)
    d = p.withColumn("lt", lt)
    text = F.when(m.isin(2, 3, 5, 6), F.array_join("lt", " ")).when(m == 7, F.concat("text", F.lit(" "), F.repeat(F.lit("* "), 16), "text")).otherwise(F.col("text"))
    d = d.select(F.col("doc_id").alias("book_id"), k.alias("id"), F.floor((k - 1) / 6).alias("page"), F.when(k % 9 == 0, "strong").alias("heading"), text.alias("text"), _lines(F.col("lt"), (k - 1) % 6 * 40, F.lit(0)).alias("lines"))
    return D.scene_breaks(d).withColumn("lines", F.size("lines"))


_PLACED = """ln AS (SELECT l_orderkey AS book_id, l_linenumber % 2 AS page, l_linenumber AS paragraph_id, l_linenumber % 3 AS col, l_extendedprice AS at, l_quantity * 8 AS x0, l_quantity * 8 + l_discount * 2000 AS x1 FROM lineitem),
im AS (SELECT o_orderkey AS book_id, k AS page, o_orderkey * 4 + k AS image_id, (o_totalprice * (k + 3)) % 500 AS x, (o_totalprice * (k + 1)) % 60000 AS y FROM orders, (SELECT unnest([0, 1, 2]) AS k))"""


@query(f"""WITH {_PLACED}, a AS (SELECT im.image_id, max(paragraph_id) AS above FROM im JOIN ln ON im.book_id = ln.book_id AND im.page = ln.page AND ln.at <= im.y AND (col = 0 OR (x >= x0 - 50 AND x <= x1 + 50)) GROUP BY image_id),
e AS (SELECT im.image_id, max(paragraph_id) AS earlier FROM im JOIN ln ON im.book_id = ln.book_id AND ln.page < im.page GROUP BY image_id)
SELECT book_id, image_id, coalesce(above, earlier, 0)::BIGINT AS after_paragraph_id FROM im LEFT JOIN a USING (image_id) LEFT JOIN e USING (image_id)""")
def image_anchors(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = F.col("l_linenumber")
    lines = li.select(F.col("l_orderkey").alias("book_id"), (n % 2).cast("long").alias("page"), n.cast("long").alias("paragraph_id"), (n % 3).cast("int").alias("col"), F.col("l_extendedprice").alias("baseline"), (F.col("l_quantity") * 8).alias("x_min"), (F.col("l_quantity") * 8 + F.col("l_discount") * 2000).alias("x_max"))
    k = F.col("page")
    images = o.select(F.col("o_orderkey").alias("book_id"), "o_totalprice", F.explode(F.array(*[F.lit(x).cast("long") for x in range(3)])).alias("page"))
    images = images.select("book_id", "page", (F.col("book_id") * 4 + k).alias("image_id"), ((F.col("o_totalprice") * (k + 3)) % 500).alias("x"), ((F.col("o_totalprice") * (k + 1)) % 60000).alias("y"), F.lit(500.0).alias("width"))
    return D.image_anchors(images, lines)


@query("""WITH i AS (SELECT l_suppkey AS book_id, l_orderkey AS page, l_partkey % 20 AS object_id, l_extendedprice % 700 AS y FROM lineitem)
SELECT book_id, object_id FROM i WHERE y + 20 <= 105 OR y >= 595 GROUP BY ALL HAVING count(DISTINCT page) >= 3""")
def recurring_edge_images(spark, sf_dir):
    y = F.col("l_extendedprice") % 700
    images = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("book_id"), F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 20).alias("object_id"), y.alias("y_min"), (y + 20).alias("y_max"), F.lit(700.0).alias("height"))
    return D.recurring_edge_images(images)


_KEY = r"trim(regexp_replace(regexp_replace(lower({c}), '^(?:chapter|section)\s+', ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_OUTLINE = f"""{Q.PARAGRAPHS}, h AS (SELECT doc_id AS book_id, (paragraph_id - 1) // 5 AS page, paragraph_id AS id, {_KEY.format(c='text')} AS k FROM p),
ln AS (SELECT doc_id AS book_id, (paragraph_id - 1) // 5 AS page, paragraph_id AS id, (paragraph_id - 1) % 5 * 20.0 + unnest([0, 9]) AS ay FROM p),
o AS (SELECT doc_id AS book_id, paragraph_id AS ord, (paragraph_id - 1) // 5 AS page, CASE WHEN paragraph_id % 3 = 0 THEN text || '!' WHEN paragraph_id % 3 = 1 THEN 'No ' || text ELSE 'No ' || paragraph_id END AS title, CASE WHEN paragraph_id % 4 > 0 THEN paragraph_id * 37 % 110 - 5.5 END AS y FROM p
  UNION ALL SELECT doc_id, 1000000 + paragraph_id, 100000, 'Beyond', 1.0 FROM p WHERE paragraph_id = 1)"""


@query(f"""WITH {_OUTLINE}, q AS (SELECT *, {_KEY.format(c='title')} AS k FROM o),
m AS (SELECT q.book_id, q.ord, h.id FROM q JOIN h ON q.book_id = h.book_id AND q.page = h.page AND (q.k = h.k OR len(list_intersect(string_split(q.k, ' '), string_split(h.k, ' '))) / len(list_distinct(string_split(q.k, ' ') || string_split(h.k, ' '))) >= 0.8)
  QUALIFY row_number() OVER (PARTITION BY q.book_id, q.ord ORDER BY q.k = h.k DESC, len(list_intersect(string_split(q.k, ' '), string_split(h.k, ' '))) / len(list_distinct(string_split(q.k, ' ') || string_split(h.k, ' '))) DESC, h.id) = 1),
n AS (SELECT o.book_id, o.ord, ln.id FROM o JOIN ln ON o.book_id = ln.book_id AND o.page = ln.page QUALIFY row_number() OVER (PARTITION BY o.book_id, o.ord ORDER BY abs(ay - y), ln.id) = 1),
f AS (SELECT book_id, page, min(id) AS id FROM ln GROUP BY ALL)
SELECT o.book_id, o.ord::BIGINT AS ord, title, coalesce(m.id, CASE WHEN y IS NOT NULL THEN n.id END, f.id)::INTEGER AS start, m.id IS NOT NULL AS matched FROM o JOIN f USING (book_id, page) LEFT JOIN m ON m.book_id = o.book_id AND m.ord = o.ord LEFT JOIN n ON n.book_id = o.book_id AND n.ord = o.ord""")
def outline_starts(spark, sf_dir):
    k = F.col("paragraph_id")
    p = paras(spark, sf_dir).withColumnRenamed("doc_id", "book_id").withColumn("page", F.floor((k - 1) / 5))
    headings = p.select("book_id", "page", "paragraph_id", F.col("text").alias("title"))
    lines = p.select("book_id", "page", "paragraph_id", F.explode(F.array(F.lit(0), F.lit(9))).alias("d")).select("book_id", "page", "paragraph_id", ((k - 1) % 5 * 20.0 + F.col("d")).alias("baseline"))
    items = p.select("book_id", k.cast("long").alias("ord"), "page", F.when(k % 3 == 0, F.concat("text", F.lit("!"))).when(k % 3 == 1, F.concat(F.lit("No "), "text")).otherwise(F.concat(F.lit("No "), k.cast("string"))).alias("title"), F.when(k % 4 > 0, k * 37 % 110 - 5.5).cast("double").alias("y"))
    beyond = p.where(k == 1).select("book_id", (k + 1_000_000).cast("long").alias("ord"), F.lit(100_000).cast("long").alias("page"), F.lit("Beyond").alias("title"), F.lit(1.0).alias("y"))
    return D.outline_starts(items.unionByName(beyond), headings, lines)


_JUDGED = r"""b AS (SELECT c_custkey AS book_id, c_name AS title, 50 + c_custkey % 200 AS paragraphs, c_custkey % 20 AS pages, CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE c_custkey % 23 END AS items FROM customer),
o AS (SELECT o_custkey AS book_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Cover Front' WHEN o_custkey % 5 = 0 THEN 'book.pdf' ELSE 'Title ' || o_orderkey END AS title, o_orderkey % 120 + 1 AS start, o_orderkey % 9 = 0 AS matched FROM orders WHERE o_orderkey % 4 < o_custkey % 4),
h0 AS (SELECT o_custkey AS book_id, CASE WHEN o_orderkey % 11 = 0 THEN 'Preface' WHEN o_orderkey % 7 = 0 THEN 'Section 2: more' WHEN o_orderkey % 5 = 0 THEN 'A name ' || o_orderkey ELSE 'Chapter ' || (o_orderkey % 150 // 25 + 1) END AS title, o_orderkey % 150 + 1 AS start, 1 + (o_orderkey % 50) / 100 AS prominence, o_orderkey % 2 = 0 AS strong FROM orders),
h AS (SELECT *, regexp_matches(title, '^(Chapter|Section)') AS marked, CASE WHEN title LIKE 'Chapter%' THEN string_split(title, ' ')[2]::INT END AS ord, title = 'Preface' AS matter, trim(regexp_replace(regexp_replace(lower(title), '^(?:chapter|section)\s+', ''), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM h0),
s AS (SELECT h.*, count(*) FILTER (strong) OVER (PARTITION BY book_id) AS ns FROM h), u AS (SELECT * FROM s WHERE (ns < 2 OR strong) AND ord IS NOT NULL), fl AS (SELECT *, coalesce(ord < lag(ord) OVER (PARTITION BY book_id ORDER BY start), false) AS f FROM u),
r AS (SELECT book_id, count(DISTINCT ord) AS rn, bool_or(f) AS rf, max(start) - min(start) AS rs FROM fl GROUP BY book_id),
n AS (SELECT b.*, coalesce(rn >= 3 AND NOT rf AND rs >= greatest(20, paragraphs * 0.2), false) AS numbered FROM b LEFT JOIN r USING (book_id)),
k AS (SELECT h.* FROM h JOIN n USING (book_id) WHERE marked OR matter OR (NOT numbered AND prominence >= 1.15)),
of AS (SELECT book_id, count(*) AS o_n, count(*) FILTER (matched) AS om, count(*) FILTER (title IN ('Cover Front', 'book.pdf')) AS oa, count(DISTINCT start) AS os, max(start) - min(start) AS ow FROM o GROUP BY book_id),
kf AS (SELECT book_id, count(*) AS k_n, count(DISTINCT key) AS kt, count(DISTINCT start) AS ks, max(start) - min(start) AS kw FROM k GROUP BY book_id),
a AS (SELECT n.*, coalesce(o_n, 0) AS o_n, coalesce(om, 0) AS om, coalesce(oa, 0) AS oa, coalesce(os, 0) AS os, ow, coalesce(k_n, 0) AS k_n, coalesce(kt, 0) AS kt, coalesce(ks, 0) AS ks, kw, greatest(20, paragraphs * 0.2) AS need FROM n LEFT JOIN of USING (book_id) LEFT JOIN kf USING (book_id)),
g AS (SELECT *, o_n > 0 AND oa >= o_n / 2 AS produced FROM a), t AS (SELECT *, om >= 2 OR (o_n >= 3 AND NOT produced AND os / greatest(o_n, 1) >= 0.6 AND coalesce(ow >= need, false)) AS trusted, numbered OR (k_n >= 3 AND kt >= 3 AND ks / greatest(k_n, 1) >= 0.75 AND coalesce(kw >= need, false)) AS fallback FROM g),
w AS (SELECT *, o_n > 0 AND NOT trusted AND (numbered OR (produced AND fallback)) AS replaced FROM t), c AS (SELECT *, CASE WHEN o_n > 0 AND NOT replaced THEN 'outline' WHEN k_n > 0 THEN 'headings' ELSE 'single' END AS source FROM w)"""


def _judged(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    cust, k = F.col("c_custkey"), F.col("o_orderkey")
    books = c.select(cust.alias("book_id"), F.col("c_name").alias("title"), (cust % 200 + 50).alias("paragraphs"), (cust % 20).alias("pages"), F.when(cust % 6 == 0, 0).otherwise(cust % 23).alias("items"))
    outline = o.where(k % 4 < F.col("o_custkey") % 4).select(F.col("o_custkey").alias("book_id"), F.when(k % 3 == 0, "Cover Front").when(F.col("o_custkey") % 5 == 0, "book.pdf").otherwise(F.concat(F.lit("Title "), k.cast("string"))).alias("title"), (k % 120 + 1).alias("start"), (k % 9 == 0).alias("matched"))
    number = (F.floor(k % 150 / 25) + 1).cast("string")
    title = F.when(k % 11 == 0, "Preface").when(k % 7 == 0, "Section 2: more").when(k % 5 == 0, F.concat(F.lit("A name "), k.cast("string"))).otherwise(F.concat(F.lit("Chapter "), number))
    headings = o.select(F.col("o_custkey").alias("book_id"), title.alias("title"), (k % 150 + 1).alias("start"), (1 + (k % 50) / 100).alias("prominence"), (k % 2 == 0).alias("strong"))
    return D.choose_chapters(books, outline, headings)


@query(f"""WITH {_JUDGED} SELECT o.book_id, 'outline' AS source, o.title, start::BIGINT AS start FROM o JOIN c USING (book_id) WHERE source = 'outline' UNION ALL SELECT k.book_id, 'headings', k.title, start FROM k JOIN c USING (book_id) WHERE source = 'headings' UNION ALL SELECT book_id, 'single', title, 1 FROM c WHERE source = 'single'""")
def printed_chapters(spark, sf_dir):
    return _judged(spark, sf_dir)[0]


@query(f"""WITH {_JUDGED}, n2 AS (SELECT *, CASE source WHEN 'outline' THEN o_n WHEN 'headings' THEN k_n ELSE 1 END AS chosen FROM c)
SELECT book_id, 'warning' AS severity, 'Weak PDF outline was replaced by a reliable visible-heading sequence' AS message FROM n2 WHERE replaced UNION ALL SELECT book_id, CASE WHEN k_n > 0 THEN 'warning' ELSE 'failure' END, 'Only ' || o_n || ' of ' || items || ' PDF outline destinations could be mapped to text' FROM n2 WHERE items > 0 AND o_n / items < 0.4
UNION ALL SELECT book_id, 'failure', 'PDF has no trustworthy outline or visible chapter headings' FROM n2 WHERE source = 'single' UNION ALL SELECT book_id, 'failure', 'Long PDF has no usable outline and too few reliable heading fallbacks' FROM n2 WHERE paragraphs > 0 AND pages >= 12 AND chosen < 2""")
def printed_chapter_diagnostics(spark, sf_dir):
    return _judged(spark, sf_dir)[1]


#: Paragraphs with chapter markers inside: every second one from the third on starts a chapter, after contents in the first; some numbers stand out of turn.
_MARKED = rf"""RECURSIVE {Q.PARAGRAPHS}, c AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
d AS (SELECT doc_id AS book_id, paragraph_id::INTEGER AS para, CASE WHEN doc_id % 6 = 5 AND paragraph_id = 5 THEN 'strong' END AS heading, CASE
  WHEN paragraph_id = 1 AND doc_id % 2 = 0 THEN 'Before Contents ' || array_to_string(list_transform(range(1, (n - 1) // 2 + 1), lambda i: 'Chapter ' || i || '. The part ' || chr((96 + i % 26)::INTEGER)), ' ')
  WHEN paragraph_id % 2 = 1 AND paragraph_id > 1 THEN substring(text, 1, 30) || ' * * * Chapter ' || ((paragraph_id - 1) // 2) || '.' || CASE WHEN doc_id % 4 = 0 THEN ' the Part ' || chr((96 + (paragraph_id - 1) // 2 % 26)::INTEGER) ELSE '' END || CASE WHEN paragraph_id = 7 THEN '' ELSE ' ' || text END
  WHEN paragraph_id = 4 AND doc_id % 3 = 0 THEN 'So chapter 9, ' || text WHEN paragraph_id = 6 AND doc_id % 5 = 0 THEN text || ' chapter one ' || text ELSE text END AS text FROM p JOIN c USING (doc_id)),
z AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY book_id ORDER BY para ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b0 FROM d),
ct AS (SELECT book_id, sum(length(text) + 1) - 1 AS length, count(*) AS paras FROM d GROUP BY book_id),
x0 AS (SELECT book_id, para, heading, b0, text, regexp_extract_all(text, '(?i)\bchapter\s+(?:\p{{N}}{{1,3}}|one)(?:[.)]|\b)') AS s FROM z),
x1 AS (SELECT *, generate_subscripts(s, 1) AS i, unnest(s) AS m FROM x0 WHERE len(s) > 0),
x2 AS (SELECT *, row_number() OVER (PARTITION BY book_id, para, m ORDER BY i) AS nth FROM x1),
mk AS (SELECT book_id, para, heading, b0 + (CASE WHEN nth = 1 THEN strpos(text, m) ELSE strpos(text, m) + strpos(substring(text, strpos(text, m) + 1), m) END) - 1 AS o, length(m) AS l, CASE WHEN lower(m) LIKE '%one%' THEN 1 ELSE regexp_extract(m, '[0-9]+')::INT END AS ord FROM x2),
sg AS (SELECT *, count(*) FILTER (ord = 1) OVER (PARTITION BY book_id ORDER BY o) AS seq FROM mk),
rn AS (SELECT book_id, seq, para, heading, o, l, ord FROM sg WHERE ord = 1 UNION ALL SELECT s.book_id, s.seq, s.para, s.heading, s.o, s.l, s.ord FROM rn r JOIN sg s ON s.book_id = r.book_id AND s.seq = r.seq AND s.ord = r.ord + 1 AND s.o > r.o AND NOT EXISTS (SELECT 1 FROM sg t WHERE t.book_id = s.book_id AND t.seq = s.seq AND t.ord = s.ord AND t.o > r.o AND t.o < s.o)),
sq AS (SELECT book_id, seq, count(*) AS n, min(o) AS first, max(o) AS last, count(DISTINCT para) AS paras, count(heading) AS headed FROM rn GROUP BY ALL)"""
_BODY = rf"""{_MARKED}, bd AS (SELECT sq.* FROM sq JOIN ct USING (book_id) WHERE sq.n >= 3 AND sq.paras = sq.n AND headed = 0 AND ct.paras >= 3 AND last - first >= greatest(500, length * 0.2) QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY sq.n DESC, last - first DESC, seq) = 1),
cn AS (SELECT sq.* FROM sq JOIN ct USING (book_id) JOIN bd ON bd.book_id = sq.book_id WHERE sq.seq <> bd.seq AND sq.n >= bd.n AND sq.last < bd.first AND sq.last - sq.first <= greatest(1500, length * 0.05) QUALIFY row_number() OVER (PARTITION BY sq.book_id ORDER BY sq.last - sq.first, sq.seq) = 1)"""


def _marked(spark, sf_dir):
    k, b = F.col("para"), F.col("book_id")
    p = paras(spark, sf_dir).select(F.col("doc_id").alias("book_id"), F.col("paragraph_id").cast("int").alias("para"), "text")
    p = p.join(p.groupBy("book_id").agg(F.count("*").alias("n")), "book_id")
    letter = lambda i: F.char(F.lit(96) + i % 26)
    numbers = F.when(F.col("n") >= 3, F.sequence(F.lit(1), F.floor((F.col("n") - 1) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    listed = F.array_join(F.transform(numbers, lambda i: F.concat(F.lit("Chapter "), i.cast("string"), F.lit(". The part "), letter(i))), " ")
    i = F.floor((k - 1) / 2).cast("int")
    chapter = F.concat(F.substring("text", 1, 30), F.lit(" * * * Chapter "), i.cast("string"), F.lit("."), F.when(b % 4 == 0, F.concat(F.lit(" the Part "), letter(i))).otherwise(""), F.when(k == 7, "").otherwise(F.concat(F.lit(" "), "text")))
    text = (
        F.when((k == 1) & (b % 2 == 0), F.concat(F.lit("Before Contents "), listed))
        .when((k % 2 == 1) & (k > 1), chapter)
        .when((k == 4) & (b % 3 == 0), F.concat(F.lit("So chapter 9, "), "text"))
        .when((k == 6) & (b % 5 == 0), F.concat("text", F.lit(" chapter one "), "text"))
        .otherwise(F.col("text"))
    )
    return p.select("book_id", "para", F.when((b % 6 == 5) & (k == 5), "strong").alias("heading"), text.alias("text"))


@query(f"WITH {_MARKED} SELECT book_id, seq, n::INTEGER AS n, first, last FROM sq")
def chapter_sequences(spark, sf_dir):
    return D.chapter_sequences(D.chapter_markers(_marked(spark, sf_dir))).drop("run")


@query(rf"""WITH {_BODY}, tm AS (SELECT rn.*, lead(rn.o) OVER (PARTITION BY rn.book_id ORDER BY rn.o) AS nx, bd.first AS bf FROM rn JOIN cn USING (book_id, seq) JOIN bd USING (book_id)),
t0 AS (SELECT tm.*, least(coalesce(nx, (SELECT min(o) FROM mk WHERE mk.book_id = tm.book_id AND mk.o > tm.o), bf), o + l + 160) AS stop, (SELECT string_agg(text, chr(10) ORDER BY para) FROM z WHERE z.book_id = tm.book_id) AS doc FROM tm),
t1 AS (SELECT *, {Q.norm('substring(doc, (o + l + 1)::BIGINT, (stop - o - l)::BIGINT)')} AS suffix, {Q.norm('substring(doc, (o + 1)::BIGINT, l)')} AS label FROM t0),
ti AS (SELECT book_id, ord, label || ' ' || suffix AS title FROM t1 WHERE suffix <> '' AND len({Q.tokens('suffix')}) <= 16 AND NOT regexp_matches(suffix, '[.!?]\s+\p{{Lu}}')),
hb AS (SELECT rn.book_id, rn.para, rn.o - z.b0 AS local, rn.l, z.text, z.heading, title FROM rn JOIN bd USING (book_id, seq) JOIN z ON z.book_id = rn.book_id AND z.para = rn.para LEFT JOIN ti ON ti.book_id = rn.book_id AND ti.ord = rn.ord),
hc AS (SELECT *, CASE WHEN title IS NOT NULL AND starts_with(lower(substring(text, local + 1)), lower(title)) THEN length(title) ELSE l END AS taken FROM hb),
pc AS (SELECT book_id, para, 0 AS piece, heading, trim(regexp_replace({Q.norm('substring(text, 1, local)')}, '(?:\s*\*){{3,}}\s*$', '')) AS text FROM hc UNION ALL SELECT book_id, para, 1, 'strong', {Q.norm('substring(text, local + 1, taken)')} FROM hc UNION ALL SELECT book_id, para, 2, heading, {Q.norm('substring(text, local + taken + 1)')} FROM hc),
ls AS (SELECT DISTINCT rn.book_id, rn.para FROM rn JOIN cn USING (book_id, seq)),
rs AS (SELECT z.book_id, z.para, 0 AS piece, z.heading, CASE WHEN ls.para IS NULL THEN z.text WHEN regexp_matches(z.text, '(?i)\bcontents\b') THEN {Q.norm("substring(z.text, 1, strpos(lower(z.text), 'contents') - 1)")} ELSE '' END AS text FROM z LEFT JOIN ls ON ls.book_id = z.book_id AND ls.para = z.para LEFT JOIN hb ON hb.book_id = z.book_id AND hb.para = z.para WHERE hb.para IS NULL)
SELECT * FROM pc WHERE text <> '' UNION ALL SELECT * FROM rs WHERE text <> ''""")
def embedded_headings(spark, sf_dir):
    return D.embedded_headings(_marked(spark, sf_dir))


#: What stands before a paragraph, by turns, to make lines of all kinds.
_PREFIX = ("", "Chapter 1", "Chapter II: ", "Part one ", "Prologue", "APPENDIX A - ", "12. ", "Section 3 – ", "Book xyz ", "iv) ", "Preface and Acknowledgements: ", "Introduction ")
_NUM = "(?:\\p{N}{1,3}|[ivxlcdm]{1,8}|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty)"


@query(rf"""WITH {Q.PARAGRAPHS}, x AS (SELECT doc_id, paragraph_id, ([{', '.join(map(repr, _PREFIX))}])[paragraph_id % {len(_PREFIX)} + 1] || CASE WHEN paragraph_id % 5 = 0 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN paragraph_id % 5 = 1 AND paragraph_id % 12 > 0 THEN '' ELSE text END AS t, paragraph_id % 50 AS x0, paragraph_id % 50 + length(text) % 200 AS x1, 10.0 + paragraph_id % 3 * 2 AS font FROM p),
y AS (SELECT *, {Q.norm('t')} AS n, font >= 11.7 AS e, len({Q.tokens('t')}) AS w, list_filter(string_split(t, ''), lambda c: regexp_matches(c, '\p{{L}}')) AS l FROM x), z AS (SELECT *, {Q.norm(f"regexp_extract(n, '(?is)^(?:chapter|book|part|section)[[:space:]]+{_NUM}(.*)$', 1)")} AS r FROM y)
SELECT doc_id, paragraph_id, t AS text, CASE WHEN length(t) > 180 OR w NOT BETWEEN 1 AND 20 OR regexp_matches(t, '\.{{3,}}') THEN NULL
  WHEN CASE WHEN regexp_matches(n, '(?is)^(?:chapter|book|part|section)\s+{_NUM}') THEN regexp_matches(r, '^[.)]?$') OR regexp_matches(r, '^[:\-\x{{2013}}\x{{2014}}]\s*\S') OR e
    ELSE regexp_matches(n, '(?is)^(?:prologue|epilogue|contents|acknowledge?ments?|preface(?:\s+and\s+acknowledge?ments?)?|foreword|afterword|appendix(?:\s+(?:\p{{N}}{{1,3}}|[a-z]|[ivxlcdm]{{1,8}}))?)(?:\s*[:.\-\x{{2014}}]\s*.*)?$') OR (e AND (regexp_matches(n, '(?i)^(?:introduction|prologue|epilogue|preface|foreword|afterword|appendix)\b') OR regexp_matches(n, '(?i)^(?:\p{{N}}{{1,3}}|[ivxlcdm]{{1,8}})[.)]?\s+[\p{{Lu}}\p{{Ll}}\p{{Lt}}]'))) END THEN 'strong'
  WHEN (len(l) >= 3 AND len(list_filter(l, lambda c: c = upper(c) AND c <> 'ß')) / len(l) >= 0.9 AND w <= 12) OR (e AND (abs((x0 + x1) / 2 - 100) <= 24 OR w <= 10)) THEN 'typographic' END AS heading FROM z""")
def printed_heading_kinds(spark, sf_dir):
    k = F.col("paragraph_id")
    p = paras(spark, sf_dir)
    before = F.element_at(F.array(*[F.lit(x) for x in _PREFIX]), (k % len(_PREFIX) + 1).cast("int"))
    small = "abcdefghijklmnopqrstuvwxyz"
    capitals = F.translate("text", small, small.upper())
    text = F.concat(before, F.when(k % 5 == 0, capitals).when((k % 5 == 1) & (k % 12 > 0), "").otherwise(F.col("text")))
    x0 = (k % 50).cast("double")
    lines = p.select("doc_id", "paragraph_id", text.alias("t"), x0.alias("x0"), (x0 + F.length("text") % 200).alias("x1"), (k % 3 * 2 + 10.0).alias("font"))
    return lines.select("doc_id", "paragraph_id", F.col("t").alias("text"), D.heading_kind(F.col("t"), F.col("x0"), F.col("x1"), F.col("font"), F.lit(200.0), F.lit(10.0)).alias("heading"))


@query(rf"""WITH {Q.PARAGRAPHS}, t AS (SELECT doc_id AS book_id, sum(len({Q.tokens('text')})) AS words, sum(length(text) + 1) - 1 AS chars, sum(length(regexp_replace(text, '[^\x{{FFFD}}\x{{E000}}-\x{{F8FF}}]', '', 'g'))) AS odd FROM p GROUP BY doc_id),
g AS (SELECT doc_id AS book_id, paragraph_id AS page, length(text) > 1500 AS has, length(text) % 3 AS images, length(text) AS items, CASE WHEN length(text) % 2 = 0 THEN length(text) ELSE 0 END AS vertical FROM p),
s AS (SELECT book_id, count(*) AS pages, count(*) FILTER (has) AS tp, count(*) FILTER (images > 0) AS ip, sum(items) AS items, sum(vertical) AS vertical FROM g GROUP BY book_id), f AS (SELECT s.*, words, chars, odd, words < 20 OR chars < 80 AS few FROM s JOIN t USING (book_id))
SELECT book_id, 'unusable_text' AS code, CASE WHEN ip / pages >= 0.5 THEN 'PDF appears to be scanned or image-only; OCR is out of scope for this phase' ELSE 'PDF does not contain enough usable selectable text for a book import' END AS message FROM f WHERE few
UNION ALL SELECT book_id, 'picture_heavy', 'Most PDF pages lack usable selectable text; the document likely requires OCR' FROM f WHERE NOT few AND pages >= 4 AND tp / pages < 0.25 AND words / pages < 20
UNION ALL SELECT book_id, 'other_failure', 'Vertical or heavily rotated text cannot yet be reconstructed reliably' FROM f WHERE items >= 20 AND vertical / items >= 0.25
UNION ALL SELECT book_id, 'garbled_text', 'Extracted PDF text contains too many replacement or private-use characters' FROM f WHERE odd >= 10 AND odd / greatest(chars, 1) > 0.02""")
def printed_quality(spark, sf_dir):
    p = paras(spark, sf_dir).withColumnRenamed("doc_id", "book_id")
    n = F.length("text")
    pages = p.select("book_id", F.col("paragraph_id").alias("page"), (n > 1500).alias("has_text"), (n % 3).alias("images"), n.alias("items"), F.when(n % 2 == 0, n).otherwise(0).alias("vertical_items"))
    return D.quality_diagnostics(p, pages).select("book_id", "code", "message")
