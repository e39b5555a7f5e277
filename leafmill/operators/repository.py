"""The repository: seven tables, upserts, patches, cascades, attempts, and the library views over them.

Plain Parquet has no row updates; writes append to a log and reads take the last row of a key, or a table is replaced whole
through a staging folder. All of it is aggregates on keys: nothing is sorted whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill import schemas as S
from leafmill.functions import text as T


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last written row of each key: an aggregate with partial sums, not a window sort. ``order`` ends in a unique column."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*log.columns)


def upserted(log: DataFrame, keys: list[str], order: list[str], immutable: list[str]) -> DataFrame:
    """As ``latest``, but immutable columns are those of the first row."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"), F.min_by(F.struct(*rest), F.struct(*order)).alias("f"))
    return best.select(*keys, *[F.col(f"{'f' if c in immutable else 'r'}.{c}").alias(c) for c in rest]).select(*log.columns)


def patched(rows: DataFrame, patch: DataFrame, keys: list[str], immutable: list[str] = (), given: str | None = None) -> DataFrame:
    """Each row with the patch's columns; ``patch`` has one row a key at most. Patches of missing keys do nothing (see ``missing_patches``).

    ``given`` names a column of the patch that lists the columns it sets, to null too; without it a patch sets its non-null
    columns. A patch that lists an immutable column fails the job.
    """
    change = [c for c in patch.columns if c not in keys and c not in immutable and c != given and c in rows.columns]
    listed = F.col(given) if given else F.lit(None).cast("array<string>")
    if given and immutable:
        bad = F.arrays_overlap(listed, F.array(*[F.lit(c) for c in immutable]))
        listed = F.when(bad, F.raise_error(F.lit(f"a patch may not set {', '.join(immutable)}")).cast("array<string>")).otherwise(listed)
    p = patch.select(*keys, listed.alias("__given"), *[F.col(c).alias(f"__p_{c}") for c in change])
    joined = rows.join(p, keys, "left")
    if given:
        new = lambda c: F.when(F.array_contains("__given", c), F.col(f"__p_{c}")).otherwise(F.col(c))
    else:
        new = lambda c: F.coalesce(f"__p_{c}", c)
    return joined.select([new(c).alias(c) if c in change else F.col(c) for c in rows.columns])


def get_book(books: DataFrame, book_id: object) -> DataFrame:
    """The book's row; none if it does not exist."""
    return books.where(F.col("id") == F.lit(book_id))


def set_status(books: DataFrame, changes: DataFrame) -> DataFrame:
    """Status, error (null clears it) and time of books; ``changes``: id, processing_status, processing_error, updated_at."""
    given = F.array(*[F.lit(c) for c in ("processing_status", "processing_error", "updated_at")])
    return patched(books, changes.withColumn("given", given), ["id"], ["created_at"], "given")


def refused_statuses(books: DataFrame, changes: DataFrame) -> DataFrame:
    """The changes that ``set_status`` cannot apply, as their book does not exist."""
    return changes.join(books.select("id"), "id", "left_anti")


def set_book_and_job_status(books: DataFrame, jobs: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(books, jobs, refused changes): a change applies to its book and its job together, or, where either is missing, to neither.

    ``changes``: book_id, attempt, status, error, updated_at, has_finished, finished_at; a job keeps its finished_at unless has_finished.
    """
    both = changes.join(books.select(F.col("id").alias("book_id")), "book_id", "left_semi").join(jobs.select("book_id", "attempt"), ["book_id", "attempt"], "left_semi")
    on_books = both.select(F.col("book_id").alias("id"), F.col("status").alias("processing_status"), F.col("error").alias("processing_error"), "updated_at")
    given = F.when(F.col("has_finished"), F.array(F.lit("status"), F.lit("error"), F.lit("finished_at"))).otherwise(F.array(F.lit("status"), F.lit("error")))
    on_jobs = both.select("book_id", "attempt", "status", "error", "finished_at", given.alias("given"))
    return set_status(books, on_books), patched(jobs, on_jobs, ["book_id", "attempt"], given="given"), changes.join(both, ["book_id", "attempt"], "left_anti")


def job_list(jobs: DataFrame, book_id: object) -> DataFrame:
    """A book's jobs by attempt."""
    return jobs.where(F.col("book_id") == F.lit(book_id)).orderBy("attempt")


#: Tables that hold a book's content.
CONTENT = ("book_chunks", "book_chapters", "book_images")


def clear_all_books(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables empty but the settings."""
    return {name: df if name == "app_settings" else df.limit(0) for name, df in tables.items()}


def clear_content(tables: dict[str, DataFrame], cleared: DataFrame) -> dict[str, DataFrame]:
    """Books without chunks, chapters and images, their totals 0; ``cleared``: book_id, updated_at."""
    zero = cleared.select(F.col("book_id").alias("id"), "updated_at", *[F.lit(0).alias(c) for c in ("total_chunks", "total_paragraphs", "total_words")])
    out = {name: df.join(cleared.select("book_id"), "book_id", "left_anti") if name in CONTENT else df for name, df in tables.items()}
    return out | {"books": patched(tables["books"], zero, ["id"])}


def replace_content(tables: dict[str, DataFrame], content: dict[str, DataFrame], totals: DataFrame) -> dict[str, DataFrame]:
    """The books of ``totals`` with new content; other books as they are.

    ``content`` has the new rows of the three content tables in order of ``pos``: they are numbered from 0; chapters without a
    kind or a level get those of their title. ``totals``: book_id, total_chunks, total_paragraphs, total_words, updated_at.
    Rows of books that don't exist are left out, as the whole write would be.
    """
    real = totals.join(tables["books"].select(F.col("id").alias("book_id")), "book_id", "left_semi")
    out = clear_content(tables, real.select("book_id", "updated_at"))
    number = F.row_number().over(Window.partitionBy("book_id").orderBy("pos")) - 1
    for name, index in zip(CONTENT, ("chunk_index", "chapter_index", "image_index")):
        if name not in content:
            continue
        rows = content[name].join(real.select("book_id"), "book_id", "left_semi").withColumn(index, number)
        if name == "book_chapters":
            rows = rows.withColumn("kind", F.coalesce("kind", T.nav_kind("title"))).withColumn("level", F.coalesce("level", T.nav_level(F.col("kind"))))
        out[name] = out[name].unionByName(rows.select(tables[name].columns))
    return out | {"books": patched(tables["books"], real.withColumnRenamed("book_id", "id"), ["id"])}


def book_aggregate(tables: dict[str, DataFrame], book_id: object) -> dict[str, DataFrame]:
    """A book's row, and its chapters, chunks and images in order."""
    own = lambda name, order: tables[name].where(F.col("book_id") == F.lit(book_id)).orderBy(order)
    return {"book": get_book(tables["books"], book_id), "chapters": own("book_chapters", "chapter_index"), "chunks": own("book_chunks", "chunk_index"), "images": own("book_images", "image_index")}


def settings(log: DataFrame) -> DataFrame:
    """The last value put for each key, by key; ``log``: key, value_json, pos."""
    return latest(log, ["key"], ["pos"]).select("key", "value_json").orderBy("key")


def put_setting(log: DataFrame, key: str, value: object) -> DataFrame:
    """The log with one more value, written as JSON."""
    after = log.agg(F.lit(key).alias("key"), F.lit(json.dumps(value, separators=(",", ":"))).alias("value_json"), (F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("pos"))
    return log.unionByName(after.select(log.columns))


def delete_progress(progress: DataFrame, gone: DataFrame) -> DataFrame:
    return progress.join(gone.select("book_id"), "book_id", "left_anti")


def resumed(progress: DataFrame, paras: DataFrame, books: DataFrame) -> DataFrame:
    """book_id, mode, paragraph_id, word_index at which reading goes on.

    A saved paragraph that the book lacks, or none, gives its first paragraph and word 0; a book without paragraphs gives
    mode ``normal`` and paragraph 1; the mode is the saved one where the book has paragraphs. ``paras``: book_id, paragraph_id.
    """
    first = paras.groupBy("book_id").agg(F.min("paragraph_id").alias("first"))
    real = progress.join(paras, ["book_id", "paragraph_id"], "left_semi").select("book_id", F.lit(True).alias("real"))
    out = books.select("book_id").join(first, "book_id", "left").join(progress, "book_id", "left").join(real, "book_id", "left")
    some, good = F.col("first").isNotNull(), F.coalesce("real", F.lit(False))
    return out.select(
        "book_id",
        F.when(some, F.coalesce("mode", F.lit("normal"))).otherwise("normal").alias("mode"),
        F.when(good, F.col("paragraph_id")).otherwise(F.coalesce("first", F.lit(1))).alias("paragraph_id"),
        F.when(good, F.greatest(F.lit(0), F.col("word_index"))).otherwise(0).alias("word_index"),
    )


def missing_patches(rows: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """The patches whose row does not exist; a caller that must not lose one raises on these."""
    return patch.join(rows.select(*keys), keys, "left_anti")


def next_attempt(jobs: DataFrame, key: str = "book_id") -> DataFrame:
    return jobs.groupBy(key).agg((F.coalesce(F.max("attempt"), F.lit(0)) + 1).alias("next_attempt"))


def list_books(books: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """Newest first; no statuses means all."""
    some = books.where(F.col("processing_status").isin(*statuses)) if statuses else books
    return some.orderBy(F.desc("created_at"), "id")


def delete_books(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without these books: every child table has book_id, settings stay."""
    out = {}
    for name, df in tables.items():
        key = "id" if name == "books" else "book_id"
        out[name] = df if name == "app_settings" else df.join(gone.select(F.col("book_id").alias(key)), key, "left_anti")
    return out


def chunk_paragraph_rows(chunks: DataFrame, key: str = "book_id") -> DataFrame:
    """Paragraphs of stored chunks; malformed JSON is an empty list and bad entries are dropped."""
    parsed = F.coalesce(F.from_json("paragraphs_json", S.CHUNK_JSON), F.array().cast(S.CHUNK_JSON))
    good = F.filter(parsed, lambda x: x["id"].isNotNull() & x["text"].isNotNull())
    return chunks.select(key, "chunk_index", F.inline(good)).withColumnRenamed("id", "paragraph_id")


def encode_chunks(chunks: DataFrame, key: str = "book_id") -> DataFrame:
    return chunks.select(key, "chunk_index", F.to_json("paragraphs").alias("paragraphs_json"))


def readable_books(books: DataFrame, chunks: DataFrame, chapters: DataFrame, images: DataFrame) -> DataFrame:
    """One row for each completed book with its paragraphs, chapters and images in order."""
    nest = lambda df, order, *cols: df.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias("rows"))
    texts = nest(chunk_paragraph_rows(chunks), "chunk_index", "paragraph_id", "text").withColumnRenamed("rows", "paragraphs")
    parts = nest(chapters, "chapter_index", "title", "start_paragraph_id", "kind", "level").withColumnRenamed("rows", "chapters")
    named = images.withColumn("image_id", F.concat("book_id", F.lit("-img-"), F.col("image_index").cast("string")))
    pictures = nest(named, "image_index", "image_id", "after_paragraph_id", "alt", "src").withColumnRenamed("rows", "images")
    out = books.where("processing_status = 'completed'").withColumnRenamed("id", "book_id")
    return reduce(lambda a, b: a.join(b, "book_id", "left"), (texts, parts, pictures), out)


def status_label(status: Column) -> Column:
    return F.when(status == "queued", "Queued").when(status == "failed", "Failed").when(status == "completed", "Completed").otherwise("Processing")


def source_format(uri: Column) -> Column:
    path = F.get(F.split(T.safe_uri_decode(F.lower(F.trim(uri))), "[?#]"), F.lit(0))
    return F.when(path.endswith(".epub"), "EPUB").when(path.endswith(".pdf"), "PDF")


def description(status: Column, error: Column, words: Column, paragraphs: Column) -> Column:
    done = F.concat(F.format_number(words, 0), F.lit(" words · "), F.format_number(paragraphs, 0), F.lit(" paragraphs"))
    return F.when(status == "failed", F.coalesce(error, F.lit("Import failed"))).when(status != "completed", "Import in progress").otherwise(done)


def estimate_progress(total: Column, paragraph_id: Column) -> Column:
    """Library progress by paragraph: 0 at the first."""
    at = F.greatest(F.lit(1), F.least(total, paragraph_id))
    return F.when(total <= 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), T.js_round((at - 1) / F.greatest(total, F.lit(1)) * 100))))


def library_entries(books: DataFrame, progress: DataFrame) -> DataFrame:
    """Display rows of all books; books without progress are at 0 percent."""
    p = progress.select(F.col("book_id").alias("id"), "paragraph_id")
    status = F.col("processing_status")
    return books.join(p, "id", "left").select(
        "id",
        "title",
        F.coalesce("author", F.lit("Unknown author")).alias("author"),
        status_label(status).alias("status_label"),
        F.coalesce(estimate_progress(F.col("total_paragraphs"), F.col("paragraph_id")), F.lit(0)).alias("progress_percent"),
        source_format(F.col("source_uri")).alias("source_format"),
        description(status, F.col("processing_error"), F.col("total_words"), F.col("total_paragraphs")).alias("description"),
    )


def book_search(books: DataFrame, text: str) -> DataFrame:
    """Title or author contains the text, regardless of case; blank finds all."""
    q = text.strip().lower()
    return books.where(F.lower("title").contains(q) | F.coalesce(F.lower("author").contains(q), F.lit(False))) if q else books


#: What readers are told of an import's phase.
PHASES = {"queued": "Waiting in queue", "validating": "Processing", "extracting_metadata": "Extracting metadata", "extracting_text": "Extracting text", "building_chapters": "Building chapters", "completed": "Completed", "failed": "Failed", "canceled": "Canceled"}


def phase_label(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv]), status), F.lit("Processing"))


def is_active(status: Column) -> Column:
    """Whether an import still runs or waits."""
    return F.coalesce(status.isin("queued", "validating", "extracting_metadata", "extracting_text", "building_chapters"), F.lit(False))


def batch_progress(imports: DataFrame, key: str = "batch_id") -> DataFrame:
    """(key, total, finished, active, remaining_ms): how far each batch is, and how long the rest will take at its pace so far (null while nothing has ended or nothing is left).

    ``imports``: key, status, elapsed_ms (of the batch so far).
    """
    facts = imports.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("completed", "failed", "canceled")).alias("finished"), F.count_if(is_active(F.col("status"))).alias("active"), F.max("elapsed_ms").alias("elapsed"))
    left = F.col("total") - F.col("finished")
    eta = F.when((F.col("finished") > 0) & (left > 0) & (F.col("elapsed") > 0), F.col("elapsed") / F.col("finished") * left)
    return facts.select(key, "total", "finished", "active", eta.cast("double").alias("remaining_ms"))


def batch_summary(tracked: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Counts of a batch: books without an outcome are canceled; those with issues are among the completed."""
    j = tracked.join(outcomes, "book_id", "left").withColumn("state", F.coalesce("status", F.lit("canceled")))
    done = F.col("state") == "completed"
    return j.agg(F.count_if(done).alias("ok"), F.count_if(done & F.coalesce(F.col("issues") > 0, F.lit(False))).alias("with_issues"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("state") == "canceled").alias("canceled"), F.sum("size_bytes").alias("bytes"))


def import_snapshot(books: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(book_id, status, error, warnings) of all imports: stored books, and ended ones whose book is gone.

    ``books``: id, processing_status, processing_error, processing_warnings; ``outcomes``: book_id, status, error, warnings.
    """
    stored = books.select(F.col("id").alias("book_id"), F.col("processing_status").alias("status"), F.col("processing_error").alias("error"), F.col("processing_warnings").alias("warnings"))
    return stored.unionByName(outcomes.select("book_id", "status", "error", "warnings").join(stored.select("book_id"), "book_id", "left_anti"))


def manifest_merge(found: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Discovered and known items together; downloaded ones are immutable, others take what was discovered."""
    cols = [c for c in found.columns if c != key]
    f, k = found.select(key, F.struct(*cols).alias("f")), known.select(key, F.struct(*cols).alias("k"))
    pick = F.when(F.col("k.status") == "downloaded", F.col("k")).otherwise(F.coalesce("f", "k"))
    return f.join(k, key, "full").select(key, pick.alias("r")).select(key, "r.*")


#: Schema of the snapshots that are written.
VERSION = 4


def _with_images(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    spark = next(iter(tables.values())).sparkSession
    return {"book_images": spark.createDataFrame([], S.TABLES["book_images"]), **tables}


def _with_column(table: str, column: str, value: str) -> Callable[[dict[str, DataFrame]], dict[str, DataFrame]]:
    return lambda tables: {**tables, table: tables[table].withColumn(column, F.expr(value)) if column not in tables[table].columns else tables[table]}


#: Steps that lift the tables of the version before to this one, in order.
MIGRATIONS: dict[int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]] = {
    2: _with_images,
    3: _with_column("books", "processing_warnings", "NULL"),
    4: _with_column("import_jobs", "attempt", "1"),
}


def migrate(tables: dict[str, DataFrame], version: int) -> dict[str, DataFrame]:
    """Tables of an older version as tables of the newest; those of a newer one are refused. Steps are projections, so nothing is read before it is asked for."""
    if not 1 <= version <= VERSION:
        raise ValueError(f"a snapshot of version {version} can't be read; this program reads 1 to {VERSION}")
    for step in range(version + 1, VERSION + 1):
        tables = MIGRATIONS[step](tables)
    return tables


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """All tables under a fresh folder; the pointer file, which names folder and version, is written last, so that readers see all of it or the one before."""
    spark = next(iter(tables.values())).sparkSession
    folder = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{folder}/{name}")
    spark.createDataFrame([(folder, VERSION, ",".join(sorted(tables)))], "version string, schema int, tables string").coalesce(1).write.mode("overwrite").parquet(f"{path}/current")


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot, lifted to the newest version. A pointer without a version (of the first ones) counts as version 1."""
    pointer = spark.read.schema("version string, schema int, tables string").parquet(f"{path}/current").first()
    version = pointer["schema"] or 1
    if version > VERSION:
        migrate({}, version)
    names = pointer["tables"].split(",") if pointer["tables"] else [n for n in S.TABLES if version > 1 or n != "book_images"]
    tables = migrate({n: spark.read.parquet(f"{path}/{pointer['version']}/{n}") for n in names}, version)
    return {n: tables[n].select([F.col(f.name).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schema).schema]) for n, schema in S.TABLES.items() if n in tables}


def required(df: DataFrame, *columns: str) -> DataFrame:
    """Fails the job on a null in a column that must have a value."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    return df.where(F.when(bad, F.raise_error(F.lit(f"a required value is missing: {', '.join(columns)}")).cast("boolean")).otherwise(True))
