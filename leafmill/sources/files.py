"""File sources: format detection, selection, folder scans and trees, catalogs and manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from leafmill import schemas as S
from leafmill.functions import text as T

#: Accepted media types.
BOOK_TYPES = ("application/epub+zip", "application/pdf", "application/x-pdf")


#: Rows that leave a task together.
TOGETHER = 2048


def flat_map(df: DataFrame, schema: str, rows: Callable[[dict], Iterable[dict]], error: Callable[[dict, Exception], dict] | None = None) -> DataFrame:
    """Any number of rows for each row, one input row in memory at a time; a row that fails gives its error row, never a failed job. Rows leave in batches of about ``TOGETHER``."""
    kind = _parse_datatype_string(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = to_arrow_schema(kind), []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                try:
                    held += list(rows(row))
                except Exception as e:  # one bad book never fails a batch
                    if error is None:
                        raise
                    held.append(error(row, e))
                if len(held) >= TOGETHER:
                    yield pa.RecordBatch.from_pylist(held, schema=out)
                    held = []
        yield pa.RecordBatch.from_pylist(held, schema=out)

    return df.mapInArrow(run, kind)


def scan(spark: SparkSession, path: str, pattern: str = "*", limit: int | None = 1000) -> DataFrame:
    """Files under a folder, recursively: path, name, length, content. ``limit`` is a cap on one folder, the first by path; None reads all.

    The paths are chosen from rows without contents, which are read for the chosen files only, each where its task is.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    df = df.withColumn("name", T.path_basename("path")).where(supported(F.lit(None).cast("string"), F.col("name")))
    if not limit:
        return df
    chosen = df.select("path").orderBy("path").limit(limit)  # so many names at most
    return df.join(F.broadcast(chosen), "path", "left_semi")


def supported(mime: Column, name: Column) -> Column:
    return F.coalesce(F.lower(F.trim(mime)).isin(*BOOK_TYPES), F.lit(False)) | F.coalesce(F.lower(name).rlike(r"\.(epub|pdf)\z"), F.lit(False))


def detect_format(content: Column) -> Column:
    """By the first bytes: epub for a ZIP, pdf, else null."""
    head = F.hex(F.substring(content, 1, 5))
    return F.when(head == "255044462D", "pdf").when(head.startswith("504B"), "epub")


def format_error(content: Column, name: Column) -> Column:
    """Why the bytes don't fit the name; null if they do."""
    found, ext = detect_format(content), F.regexp_extract(F.lower(name), r"\.(epub|pdf)\z", 1)
    return F.when(found.isNull(), "Unsupported format").when((ext != "") & (ext != found), F.concat(F.lit("File extension does not match its content: "), found))


def validate_source(name: Column, size: Column) -> Column:
    """The error bucket of a file by name and size; null for a good one."""
    return F.when(~F.coalesce(F.lower(name).rlike(r"\.(epub|pdf)\z"), F.lit(False)), "Unsupported format").when(size > S.MAX_FILE_BYTES, "File too large")


def folder_tree(files: DataFrame) -> DataFrame:
    """(path, depth, books, bytes) of every folder: each file counts for all of its path's prefixes. ``files``: path, size."""
    parts = F.filter(F.split("path", r"[\\/]+"), lambda x: ~x.isin("", "."))
    n = F.size("parts") - 1
    prefixes = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.array_join(F.slice("parts", F.lit(1), k), "/").alias("path"), k.alias("depth"))))
    return files.withColumn("parts", parts).select("size", F.inline(prefixes)).groupBy("path", "depth").agg(F.count("*").alias("books"), F.sum("size").alias("bytes"))


def csv_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Texts in English of a quoted catalog file with embedded line ends."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.where((F.col("Type") == "Text") & F.array_contains(F.transform(F.split("Language", ";"), lambda s: F.trim(s)), "en"))


MANIFEST = "id STRING, format STRING, source STRING, url STRING, title STRING, authors ARRAY<STRING>, status STRING, reason STRING, path STRING, sha256 STRING, bytes BIGINT"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path).where("id IS NOT NULL")


def select_per_format(manifest_: DataFrame, n: int) -> DataFrame:
    """The first ``n`` downloaded of each format, in the corpus's order: baseline id, hash of the id, id."""
    from pyspark.sql import Window

    w = Window.partitionBy("format").orderBy(T.fnv1a("id"), "id")
    return manifest_.where("status = 'downloaded'").withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).drop("n")


def write_raw(files: DataFrame, path: str) -> None:
    """Raw sources as Parquet, one row a book."""
    files.select("book_id", "file_name", "mime_type", "content", F.length("content").alias("size_bytes")).write.mode("overwrite").parquet(path)


def decode_markup(data: bytes) -> str:
    """Markup bytes to text: byte order mark, then the declared encoding in the first 512 bytes, then UTF-8."""
    import codecs
    import re

    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    m = re.search(rb"(?:encoding|charset)\s*=\s*[\"']?([A-Za-z0-9._-]+)", data[:512])
    try:
        return data.decode(m[1].decode() if m else "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")
