"""Queries over the repository, the library layout and moods."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import layout as L
from leafmill.operators import model as M
from leafmill.operators import repository as R
from leafmill.plans import sql as Q
from leafmill.plans.q_text import paras
from leafmill.plans.registry import query, table


@query("SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_progress(spark, sf_dir):
    return R.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"])


@query("SELECT user_id, max(v) + 1 AS next_attempt FROM (SELECT user_id, (event_id % 17)::INTEGER AS v FROM events) GROUP BY user_id")
def next_attempt(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 17).cast("int").alias("attempt"))
    return R.next_attempt(jobs, "user_id")


@query("""WITH l AS (SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value, min(ts) AS created FROM events GROUP BY ALL) SELECT user_id, event_type, event_id, value, created AS ts FROM l""")
def upsert_log(spark, sf_dir):
    """Upserts by (user, type): the last row wins, the time of creation is the first row's."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return R.upserted(e, ["user_id", "event_type"], ["event_id"], ["ts"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'patched' ELSE c_name END AS c_name, CASE WHEN c_custkey % 6 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer""")
def patch_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    patch = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("patched").alias("c_name"), F.when(F.col("c_custkey") % 6 == 0, 0.0).alias("c_acctbal"))
    return R.patched(c, patch, ["c_custkey"])


@query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_orderdate DESC, o_orderkey")
def list_books(spark, sf_dir):
    books = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("processing_status"), F.col("o_orderdate").alias("created_at"))
    return R.list_books(books, ["F", "P"]).toDF("o_orderkey", "o_orderstatus", "o_orderdate")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')")
def delete_cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("book_id"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book_id"), "l_linenumber", "l_partkey", "l_suppkey")
    return R.delete_books({"book_images": rows}, gone)["book_images"].withColumnRenamed("book_id", "l_orderkey")


@query(f"WITH {Q.PARAGRAPHS} SELECT doc_id, ((paragraph_id - 1) // 50)::INTEGER AS chunk_index, paragraph_id, text FROM p")
def chunk_json_round_trip(spark, sf_dir):
    """Paragraphs to JSON chunks and back."""
    chunks = R.encode_chunks(M.chunk_paragraphs(paras(spark, sf_dir)), "doc_id")
    return R.chunk_paragraph_rows(chunks, "doc_id").drop("sceneBreakBefore")


@query("""SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Completed' ELSE 'Processing' END AS status_label,
  CASE WHEN n <= 0 THEN 0 ELSE greatest(0, least(100, floor((greatest(1, least(n, p)) - 1) / n * 100 + 0.5)))::BIGINT END AS progress_percent, CASE WHEN o_orderkey % 3 = 0 THEN 'EPUB' WHEN o_orderkey % 3 = 1 THEN 'PDF' END AS source_format,
  CASE o_orderstatus WHEN 'F' THEN 'Import failed' WHEN 'O' THEN format('{:,}', o_custkey * 1000) || ' words · ' || format('{:,}', n) || ' paragraphs' ELSE 'Import in progress' END AS description
FROM (SELECT *, o_orderkey % 97 AS n, o_custkey % 120 AS p FROM orders)""")
def library_entries(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    uri = F.when(k % 3 == 0, F.lit("content://x/My%20Book.EPUB?y#z")).when(k % 3 == 1, F.lit("file:///a%2Fb.pdf")).otherwise(F.lit("x.txt"))
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise("validating")
    books = o.select(k.alias("id"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("author"), status.alias("processing_status"), F.lit(None).cast("string").alias("processing_error"), uri.alias("source_uri"), (F.col("o_custkey") * 1000).alias("total_words"), (k % 97).alias("total_paragraphs"))
    progress = o.select(k.alias("book_id"), (F.col("o_custkey") % 120).alias("paragraph_id"))
    return R.library_entries(books, progress).select("id", "status_label", "progress_percent", "source_format", "description")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'lu') OR contains(lower(p_brand), '#1')")
def book_search(spark, sf_dir):
    books = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("author"))
    both = R.book_search(books, " LU ").unionByName(R.book_search(books, "#1")).distinct()
    return both.select("p_partkey", F.col("title").alias("p_name"))


@query("SELECT count(*) FILTER (o_orderstatus = 'O') AS ok, count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 5 > 0) AS with_issues, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderstatus IS NULL OR o_orderstatus = 'P') AS canceled, sum(c_custkey)::BIGINT AS bytes FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def batch_summary(spark, sf_dir):
    """Customers stand in for books; orders are their outcomes, pending ones without a status."""
    tracked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"), F.col("c_custkey").alias("size_bytes"))
    status = F.when(F.col("o_orderstatus") == "O", "completed").when(F.col("o_orderstatus") == "F", "failed")
    outcomes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), status.alias("status"), (F.col("o_orderkey") % 5).alias("issues"))
    return R.batch_summary(tracked, outcomes)


def _books(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("queued").alias("processing_status"), F.col("c_name").alias("processing_error"), F.col("c_nationkey").cast("long").alias("updated_at"), F.col("c_mktsegment").alias("created_at"))


def _jobs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("attempt"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("error"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("finished_at"))


@query("SELECT c_custkey AS id, 'queued' AS processing_status, c_name AS processing_error, c_nationkey::BIGINT AS updated_at, c_mktsegment AS created_at FROM customer WHERE c_custkey = 7")
def get_book(spark, sf_dir):
    return R.get_book(_books(spark, sf_dir), 7)


@query("""SELECT c_custkey AS id, CASE WHEN c_nationkey < 10 THEN 'failed' ELSE 'queued' END AS processing_status, CASE WHEN c_nationkey < 10 THEN CASE WHEN c_custkey % 2 = 0 THEN 'broken' END ELSE c_name END AS processing_error,
  CASE WHEN c_nationkey < 10 THEN 99 ELSE c_nationkey::BIGINT END AS updated_at, c_mktsegment AS created_at FROM customer""")
def set_status(spark, sf_dir):
    books = _books(spark, sf_dir)
    changes = books.where("updated_at < 10").select("id", F.lit("failed").alias("processing_status"), F.when(F.col("id") % 2 == 0, "broken").alias("processing_error"), F.lit(99).cast("long").alias("updated_at"))
    return R.set_status(books, changes)


@query("""SELECT c_custkey + CASE WHEN c_acctbal < 0 THEN 100000000 ELSE 0 END AS id, 'failed' AS processing_status FROM customer WHERE c_acctbal < 0""")
def refused_book_statuses(spark, sf_dir):
    books = _books(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    changes = c.select((F.col("c_custkey") + F.when(F.col("c_acctbal") < 0, 100_000_000).otherwise(0)).alias("id"), F.lit("failed").alias("processing_status"))
    return R.refused_statuses(books, changes)


@query("""SELECT c_custkey AS book_id, 'queued' AS status, c_name AS error, c_mktsegment || '?' AS warnings FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, 'canceled', NULL, c_mktsegment FROM customer WHERE c_acctbal < 0""")
def import_snapshot(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    books = c.where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"), F.lit("queued").alias("processing_status"), F.col("c_name").alias("processing_error"), F.concat("c_mktsegment", F.lit("?")).alias("processing_warnings"))
    outcomes = c.select(F.col("c_custkey").alias("book_id"), F.lit("canceled").alias("status"), F.lit(None).cast("string").alias("error"), F.col("c_mktsegment").alias("warnings"))
    return R.import_snapshot(books, outcomes)


_STATES = ("queued", "validating", "extracting_metadata", "extracting_text", "building_chapters", "completed", "failed", "canceled", "unheard of")


@query(f"""WITH i AS (SELECT o_orderkey, o_custkey AS batch_id, ([{', '.join(map(repr, _STATES))}])[o_orderkey % 9 + 1] AS status, o_custkey % 3 * 1000 AS elapsed FROM orders)
SELECT batch_id, count(*) AS total, count(*) FILTER (status IN ('completed', 'failed', 'canceled')) AS finished, count(*) FILTER (status NOT IN ('completed', 'failed', 'canceled', 'unheard of')) AS active,
  CASE WHEN count(*) FILTER (status IN ('completed', 'failed', 'canceled')) > 0 AND count(*) FILTER (status NOT IN ('completed', 'failed', 'canceled')) > 0 AND max(elapsed) > 0 THEN max(elapsed) / count(*) FILTER (status IN ('completed', 'failed', 'canceled')) * count(*) FILTER (status NOT IN ('completed', 'failed', 'canceled')) END::DOUBLE AS remaining_ms FROM i GROUP BY batch_id""")
def batch_progress(spark, sf_dir):
    return R.batch_progress(_imports(spark, sf_dir))


def _imports(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*[F.lit(x) for x in _STATES]), (k % 9 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("batch_id"), status.alias("status"), (F.col("o_custkey") % 3 * 1000).alias("elapsed_ms"))


@query("""SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'Waiting in queue' WHEN 2 THEN 'Extracting metadata' WHEN 3 THEN 'Extracting text' WHEN 4 THEN 'Building chapters' WHEN 5 THEN 'Completed' WHEN 6 THEN 'Failed' WHEN 7 THEN 'Canceled' ELSE 'Processing' END AS label, o_orderkey % 9 < 5 AS active FROM orders""")
def import_phases(spark, sf_dir):
    status = F.col("status")
    return _imports(spark, sf_dir).select("o_orderkey", R.phase_label(status).alias("label"), R.is_active(status).alias("active"))


@query("""SELECT c_custkey // 40 AS parent_id, (row_number() OVER (PARTITION BY c_custkey // 40 ORDER BY c_acctbal >= 0, c_name, c_custkey) - 1)::INTEGER AS nth, c_custkey AS id FROM customer""")
def sorted_tree(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return L.sorted_tree(c.select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 40).alias("parent_id"), F.when(F.col("c_acctbal") < 0, "folder").otherwise("book").alias("kind"), F.col("c_name").alias("name")))


def _changes(spark, sf_dir):
    """One change a customer, to the first order or, for some, to one that does not exist."""
    jobs = _jobs(spark, sf_dir)
    first = jobs.groupBy("book_id").agg(F.min("attempt").alias("attempt"))
    missing = F.col("book_id") % 5 == 0
    return first.select("book_id", F.when(missing, -1).otherwise(F.col("attempt")).alias("attempt"), F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(5).cast("long").alias("updated_at"), (F.col("book_id") % 2 == 0).alias("has_finished"), F.lit(None).cast(jobs.schema["finished_at"].dataType).alias("finished_at"))


_FIRST = "f AS (SELECT o_custkey AS book_id, CASE WHEN o_custkey % 5 = 0 THEN -1 ELSE min(o_orderkey) END AS attempt FROM orders GROUP BY o_custkey)"


@query(f"""WITH {_FIRST} SELECT o_custkey AS book_id, o_orderkey AS attempt, CASE WHEN f.attempt IS NULL THEN o_orderstatus ELSE 'completed' END AS status, CASE WHEN f.attempt IS NULL THEN o_orderpriority END AS error,
  CASE WHEN o_orderstatus = 'F' AND NOT (f.attempt IS NOT NULL AND o_custkey % 2 = 0) THEN o_orderdate END AS finished_at FROM orders LEFT JOIN f ON f.book_id = o_custkey AND f.attempt = o_orderkey""")
def set_job_status(spark, sf_dir):
    """The jobs after a change of books and jobs together; a job keeps its end unless the change names one."""
    return R.set_book_and_job_status(_books(spark, sf_dir), _jobs(spark, sf_dir), _changes(spark, sf_dir))[1]


@query(f"""WITH {_FIRST} SELECT c_custkey AS id, CASE WHEN book_id IS NULL THEN 'queued' ELSE 'completed' END AS processing_status, CASE WHEN book_id IS NULL THEN c_name END AS processing_error, CASE WHEN book_id IS NULL THEN c_nationkey::BIGINT ELSE 5 END AS updated_at, c_mktsegment AS created_at
FROM customer LEFT JOIN f ON c_custkey = book_id AND attempt >= 0""")
def set_book_status(spark, sf_dir):
    return R.set_book_and_job_status(_books(spark, sf_dir), _jobs(spark, sf_dir), _changes(spark, sf_dir))[0]


@query(f"WITH {_FIRST} SELECT book_id, attempt FROM f WHERE attempt < 0")
def refused_status_changes(spark, sf_dir):
    return R.set_book_and_job_status(_books(spark, sf_dir), _jobs(spark, sf_dir), _changes(spark, sf_dir))[2].select("book_id", "attempt")


@query("SELECT o_custkey AS book_id, o_orderkey AS attempt, o_orderstatus AS status FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey")
def job_list(spark, sf_dir):
    return R.job_list(_jobs(spark, sf_dir), 7).select("book_id", "attempt", "status")


def _content(spark, sf_dir):
    """Orders as books, their lines as chapters; an order's new chapters are its lines backwards, titled anew."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    books = o.select(F.col("o_orderkey").alias("id"), F.lit(1).alias("total_chunks"), F.lit(2).alias("total_paragraphs"), F.lit(3).alias("total_words"), F.col("o_custkey").alias("updated_at"))
    chapters = line.select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("chapter_index"), F.col("l_returnflag").alias("title"), F.col("l_suppkey").alias("start_paragraph_id"), F.lit("old").alias("kind"), F.lit(9).alias("level"))
    empty = chapters.where("false")
    tables = {"books": books, "book_chapters": chapters, "book_chunks": empty.withColumnRenamed("chapter_index", "chunk_index"), "book_images": empty.withColumnRenamed("chapter_index", "image_index"), "app_settings": empty}
    done = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("book_id"), F.lit(7).alias("total_chunks"), F.lit(8).alias("total_paragraphs"), F.lit(9).alias("total_words"), F.lit(-1).cast("long").alias("updated_at"))
    title = F.when(F.col("l_linenumber") % 3 == 0, "Part One").when(F.col("l_linenumber") % 3 == 1, "Contents").otherwise("It begins")
    new = line.select(F.col("l_orderkey").alias("book_id"), F.struct((-F.col("l_linenumber")).alias("n"), "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"), title.alias("title"), F.col("l_suppkey").alias("start_paragraph_id"), F.when(F.col("l_linenumber") == 2, "scene").alias("kind"), F.lit(None).cast("int").alias("level"))
    return tables, {"book_chapters": new}, done


@query("""WITH n AS (SELECT l_orderkey AS book_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY -l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::INTEGER AS chapter_index, CASE l_linenumber % 3 WHEN 0 THEN 'Part One' WHEN 1 THEN 'Contents' ELSE 'It begins' END AS title, l_suppkey AS start_paragraph_id,
  CASE WHEN l_linenumber = 2 THEN 'scene' WHEN l_linenumber % 3 = 0 THEN 'part' WHEN l_linenumber % 3 = 1 THEN 'frontmatter' ELSE 'chapter' END AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F')
SELECT *, (CASE kind WHEN 'scene' THEN 4 WHEN 'chapter' THEN 2 ELSE 1 END)::INTEGER AS level FROM n
UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag, l_suppkey, 'old', 9 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def replace_content(spark, sf_dir):
    return R.replace_content(*_content(spark, sf_dir))["book_chapters"]


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 7 ELSE 1 END AS total_chunks, CASE WHEN o_orderstatus = 'F' THEN 8 ELSE 2 END AS total_paragraphs, CASE WHEN o_orderstatus = 'F' THEN 9 ELSE 3 END AS total_words, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE o_custkey END AS updated_at FROM orders""")
def replace_content_totals(spark, sf_dir):
    return R.replace_content(*_content(spark, sf_dir))["books"]


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS total_chunks, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 2 END AS total_paragraphs, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 3 END AS total_words, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE o_custkey END AS updated_at,
  (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND o_orderstatus <> 'F') AS chapters FROM orders""")
def clear_content(spark, sf_dir):
    tables, _, done = _content(spark, sf_dir)
    out = R.clear_content(tables, done.select("book_id", "updated_at"))
    held = out["book_chapters"].groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("chapters"))
    return out["books"].join(held, "id", "left").na.fill(0, ["chapters"])


@query("SELECT l_orderkey AS book_id, l_linenumber AS chapter_index, l_returnflag AS title FROM lineitem WHERE l_orderkey = 1 ORDER BY l_linenumber")
def book_aggregate(spark, sf_dir):
    return R.book_aggregate(_content(spark, sf_dir)[0], 1)["chapters"].select("book_id", "chapter_index", "title")


@query("SELECT event_type AS key, arg_max(props, event_id) AS value_json FROM events GROUP BY event_type UNION ALL SELECT 'theme', '{\"dark\":true}'")
def settings(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("props").alias("value_json"), F.col("event_id").alias("pos"))
    return R.settings(R.put_setting(log, "theme", {"dark": True}))


@query(f"""WITH {Q.PARAGRAPHS}, f AS (SELECT doc_id, min(paragraph_id) AS first FROM p GROUP BY doc_id), g AS (SELECT doc_id, 'rsvp' AS mode, (doc_id % 40)::INTEGER AS paragraph_id, quality - 1 AS word_index FROM labels)
SELECT d.doc_id AS book_id, CASE WHEN first IS NOT NULL THEN coalesce(mode, 'normal') ELSE 'normal' END AS mode, CASE WHEN p.paragraph_id IS NOT NULL THEN p.paragraph_id ELSE coalesce(first, 1) END AS paragraph_id, CASE WHEN p.paragraph_id IS NOT NULL THEN greatest(0, word_index) ELSE 0 END AS word_index
FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN p ON p.doc_id = g.doc_id AND p.paragraph_id = g.paragraph_id""")
def resumed_positions(spark, sf_dir):
    progress = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("book_id"), F.lit("rsvp").alias("mode"), (F.col("doc_id") % 40).cast("int").alias("paragraph_id"), (F.col("quality") - 1).alias("word_index"))
    return R.resumed(progress, paras(spark, sf_dir).select(F.col("doc_id").alias("book_id"), "paragraph_id"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id")))


@query("""WITH f AS (SELECT p_partkey AS id, 'new' AS status, p_size AS v FROM part WHERE p_size <= 30), k AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'downloaded' ELSE 'old' END AS status, p_size + 1 AS v FROM part WHERE p_size >= 10)
SELECT coalesce(f.id, k.id) AS id, CASE WHEN k.status = 'downloaded' THEN k.status ELSE coalesce(f.status, k.status) END AS status, CASE WHEN k.status = 'downloaded' THEN k.v ELSE coalesce(f.v, k.v) END AS v FROM f FULL JOIN k ON f.id = k.id""")
def manifest_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    found = p.where("p_size <= 30").select(F.col("p_partkey").alias("id"), F.lit("new").alias("status"), F.col("p_size").alias("v"))
    known = p.where("p_size >= 10").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "downloaded").otherwise("old").alias("status"), (F.col("p_size") + 1).alias("v"))
    return R.manifest_merge(found, known)


# a tree: regions, nations under them, and a chain of folders under each nation

_FOLDERS = """f AS (SELECT 'r' || r_regionkey AS id, r_name AS label, NULL AS parent_id, r_regionkey AS ord FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey, n_nationkey FROM nation
  UNION ALL SELECT 's' || n_nationkey, n_name || ' x', 'n' || n_nationkey, 0 FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'e' || n_nationkey, 'empty', 's' || n_nationkey, 1 FROM nation WHERE n_nationkey % 4 = 0),
pl AS (SELECT c_custkey AS book_id, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 AND c_nationkey % 2 = 0 THEN 's' || c_nationkey ELSE 'n' || c_nationkey END AS parent_id, c_custkey AS ord FROM customer),
up AS (SELECT id, id AS ancestor, 0 AS distance FROM f UNION ALL SELECT u.id, f.parent_id, u.distance + 1 FROM up u JOIN f ON u.ancestor = f.id WHERE f.parent_id IS NOT NULL)"""


def _tree(spark, sf_dir):
    text = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    folders = r.select(text("r", "r_regionkey").alias("id"), F.col("r_name").alias("label"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").alias("ord"))
    folders = folders.unionByName(n.select(text("n", "n_nationkey").alias("id"), F.col("n_name").alias("label"), text("r", "n_regionkey").alias("parent_id"), F.col("n_nationkey").alias("ord")))
    folders = folders.unionByName(n.where("n_nationkey % 2 = 0").select(text("s", "n_nationkey").alias("id"), F.concat("n_name", F.lit(" x")).alias("label"), text("n", "n_nationkey").alias("parent_id"), F.lit(0).alias("ord")))
    folders = folders.unionByName(n.where("n_nationkey % 4 = 0").select(text("e", "n_nationkey").alias("id"), F.lit("empty").alias("label"), text("s", "n_nationkey").alias("parent_id"), F.lit(1).alias("ord")))
    c = F.col("c_custkey")
    parent = F.when(c % 7 == 0, None).when((c % 2 == 0) & (F.col("c_nationkey") % 2 == 0), text("s", "c_nationkey")).otherwise(text("n", "c_nationkey"))
    placements = table(spark, sf_dir, "customer").select(c.alias("book_id"), parent.alias("parent_id"), c.alias("ord"))
    return folders, placements


@query(f"WITH RECURSIVE {_FOLDERS} SELECT u.id, max(distance)::INTEGER AS depth, string_agg(f.label, '/' ORDER BY distance DESC) AS path FROM up u JOIN f ON u.ancestor = f.id GROUP BY u.id")
def folder_paths(spark, sf_dir):
    return L.paths(_tree(spark, sf_dir)[0])


@query(f"WITH RECURSIVE {_FOLDERS} SELECT ancestor AS id, count(book_id) AS books FROM up LEFT JOIN pl ON up.id = pl.parent_id GROUP BY ancestor")
def folder_rollup(spark, sf_dir):
    return L.subtree_counts(*_tree(spark, sf_dir))


@query(f"WITH RECURSIVE {_FOLDERS} SELECT id FROM up WHERE ancestor = 'r1'")
def folder_descendants(spark, sf_dir):
    return L.descendants(_tree(spark, sf_dir)[0], "r1")


@query(f"WITH RECURSIVE {_FOLDERS}, k AS (SELECT parent_id AS id FROM pl WHERE parent_id IS NOT NULL UNION SELECT id FROM f WHERE NOT starts_with(id, 'e')) SELECT DISTINCT ancestor AS id FROM up WHERE id IN (SELECT id FROM k)")
def pruned_folders(spark, sf_dir):
    folders, placements = _tree(spark, sf_dir)
    return L.pruned(folders, placements, folders.where("id LIKE 'e%'").select("id")).select("id")


@query(f"""WITH RECURSIVE {_FOLDERS}, lv AS (SELECT parent_id AS id, count(*) AS n, count(*) FILTER (book_id % 3 > 0 OR parent_id IN ('n1', 'n3')) AS on_ FROM pl WHERE parent_id IS NOT NULL GROUP BY parent_id
  UNION ALL SELECT id, 1, CASE WHEN id = 'e0' THEN 1 ELSE 0 END FROM f WHERE id NOT IN (SELECT parent_id FROM f WHERE parent_id IS NOT NULL) AND id NOT IN (SELECT parent_id FROM pl WHERE parent_id IS NOT NULL))
SELECT ancestor AS id, sum(on_) = sum(n) AS checked, sum(on_) > 0 AND sum(on_) < sum(n) AS partial FROM up JOIN lv USING (id) GROUP BY ancestor""")
def cascade_selection(spark, sf_dir):
    folders, placements = _tree(spark, sf_dir)
    books = placements.where("book_id % 3 > 0 OR parent_id IN ('n1', 'n3')").select("book_id")
    return L.cascade(folders, placements, books, folders.where("id = 'e0'").select("id"))


@query(f"WITH RECURSIVE {_FOLDERS}, s AS (SELECT id FROM f WHERE ord % 3 = 0) SELECT id FROM s WHERE id NOT IN (SELECT id FROM up WHERE distance > 0 AND ancestor IN (SELECT id FROM s))")
def root_selected(spark, sf_dir):
    folders, _ = _tree(spark, sf_dir)
    return L.root_selected(folders, folders.where("ord % 3 = 0").select("id"))


@query(f"WITH RECURSIVE {_FOLDERS} SELECT id, parent_id, (row_number() OVER (PARTITION BY parent_id ORDER BY ord, label, id) - 1)::INTEGER AS ord FROM f")
def normalized_orders(spark, sf_dir):
    return L.renumbered_folders(_tree(spark, sf_dir)[0]).select("id", "parent_id", "ord")


@query(f"WITH RECURSIVE {_FOLDERS} SELECT book_id, parent_id FROM pl WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM up WHERE ancestor = 'r2')")
def delete_folder_contents(spark, sf_dir):
    return L.delete_with_contents(*_tree(spark, sf_dir), "r2")[1].select("book_id", "parent_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unassigned_books(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("quality").alias("mood_id"), F.col("doc_id").alias("book_id"))
    return L.unassigned_rows(table(spark, sf_dir, "documents").select("doc_id"), rows, "doc_id")


@query("SELECT o_custkey AS book_id, coalesce(CASE min(o_orderpriority) WHEN '1-URGENT' THEN 'red' WHEN '2-HIGH' THEN 'blue' END, 'violet') AS color FROM orders GROUP BY o_custkey")
def mood_colors(spark, sf_dir):
    color = F.when(F.col("o_orderpriority") == "1-URGENT", "red").when(F.col("o_orderpriority") == "2-HIGH", "blue")
    return L.color_rows(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("mood_order"), color.alias("color"), F.col("o_custkey").alias("book_id")))


@query("SELECT o_orderpriority AS mood_id, o_orderkey AS pos, o_custkey AS book_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def mood_books(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("mood_id"), F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("book_id"))
    return L.mood_book_rows(rows, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id")))


@query("SELECT p_partkey, CASE WHEN a + b = 0 THEN '0 selected' ELSE concat_ws(' · ', CASE WHEN a > 0 THEN a || ' folder' || CASE WHEN a = 1 THEN '' ELSE 's' END END, CASE WHEN b > 0 THEN b || ' book' || CASE WHEN b = 1 THEN '' ELSE 's' END END) END AS label FROM (SELECT p_partkey, p_size % 3 AS a, p_partkey % 3 AS b FROM part)")
def selection_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", L.selection_label(F.col("p_size") % 3, F.col("p_partkey") % 3).alias("label"))
