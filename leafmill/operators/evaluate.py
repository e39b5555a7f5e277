"""Evaluation of a corpus: summaries, percentiles, audits, scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill import schemas as S


def summary(records: DataFrame, *by: str) -> DataFrame:
    """Total, passed, failed and the pass rate; ``records`` has a boolean ``pass``."""
    passed, n = F.count_if("pass"), F.count("*")
    return records.groupBy(*by).agg(n.alias("total"), passed.alias("passed"), (n - passed).alias("failed"), F.when(n > 0, passed / n * 100).otherwise(0.0).alias("pass_rate"))


def buckets(diagnostics: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct books for each bucket: any diagnostic, failures, warnings; buckets without any have 0."""
    spark = diagnostics.sparkSession
    every = spark.createDataFrame([(b,) for b in S.BUCKETS], "bucket string")
    of = lambda level: F.count_distinct(F.when(F.col("severity") == level, F.col(key)))
    counted = diagnostics.groupBy("bucket").agg(F.count_distinct(key).alias("books"), of("failure").alias("failures"), of("warning").alias("warnings"))
    return F.broadcast(every).join(counted, "bucket", "left").na.fill(0)


def top_failures(diagnostics: DataFrame, most: int = 3, key: str = "doc_id") -> DataFrame:
    """(rank, bucket, books, line): the buckets in which most books fail, as lines of a report; a table of a row a bucket is ranked, equal ones in the order of the buckets."""
    from pyspark.sql import Window

    order = F.array_position(F.array(*[F.lit(b) for b in S.BUCKETS]), F.col("bucket"))
    failed = buckets(diagnostics, key).where("failures > 0").select("bucket", F.col("failures").alias("books"), order.alias("at"))
    ranked = failed.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("books"), "at"))).where(F.col("rank") <= most)
    line = F.concat("bucket", F.lit(": "), F.col("books").cast("string"), F.when(F.col("books") == 1, " failed book.").otherwise(" failed books."))
    return ranked.select("rank", "bucket", "books", line.alias("line"))


#: Why an item is in the corpus, the most telling first.
REASONS = ("golden-reference", "curated-popular", "harvest-variety")


def corpus_selection(items: DataFrame, n: int, baseline: str | None = None) -> DataFrame:
    """(format, rank, id): of each format the first ``n`` items in the order of the corpus: the baseline, then by reason, then by a hash of the id, so that a selection is varied and stays as it is.

    ``items``: id, remote_id, format, reason. ``n`` up to 1,000 lets tasks drop the rest before rows are exchanged.
    """
    from pyspark.sql import Window

    from leafmill.functions import text as T

    first = F.when(F.col("remote_id") == F.lit(baseline), 0).otherwise(1)
    reason = F.when(F.array_position(F.array(*[F.lit(r) for r in REASONS[:2]]), F.col("reason")) > 0, F.array_position(F.array(*[F.lit(r) for r in REASONS[:2]]), F.col("reason")) - 1).otherwise(2)
    w = Window.partitionBy("format").orderBy(first, reason, T.fnv1a("id"), "id")
    return items.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("format", "rank", "id")


def nearest_rank(c: str | Column, p: float) -> Column:
    """The element of rank ceil(n * p)."""
    name = c if isinstance(c, str) else c._jc.toString()
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {name})")


def weighted_median(df: DataFrame, value: str, weight: str, *by: str, empty: float = 12.0) -> DataFrame:
    """The first value at which the weights up to it reach half of all; weights of 0 or less don't count, and a group that has
    no other gets ``empty``."""
    from pyspark.sql import Window

    merged = df.where(F.col(weight) > 0).groupBy(*by, value).agg(F.sum(weight).alias("w"))
    up = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    reached = merged.withColumns({"upto": F.sum("w").over(up), "all": F.sum("w").over(Window.partitionBy(*by))}).where("upto >= all / 2")
    found = reached.groupBy(*by).agg(F.min(value).cast("double").alias("weighted_median"))
    if by:
        found = df.select(*by).distinct().join(found, list(by), "left")
    return found.withColumn("weighted_median", F.coalesce("weighted_median", F.lit(empty)))


def pdf_scope(words: Column, chars: Column, text_pages: Column, pages: Column) -> Column:
    """In or out of scope by words, characters and the share of pages with text."""
    sparse = (pages >= 4) & (text_pages / F.greatest(pages, F.lit(1)) < 0.25) & (words / F.greatest(pages, F.lit(1)) < 20)
    return F.when((words < 20) | (chars < 80) | sparse, "out-of-scope").otherwise("in-scope")


def error_bucket(message: Column) -> Column:
    m = F.lower(message)
    return F.when(m.contains("aborted") | m.contains("timeout"), "Processing timeout").when(m.contains("unsupported format"), "Unsupported format").when(m.contains("too large"), "File too large").otherwise("Corrupted/Unreadable book")


def ordered_subsequence(log: Column, expected: list[str]) -> Column:
    """Whether an array holds the expected values in order, others between them allowed."""
    want = F.array(*[F.lit(x) for x in expected])
    return F.aggregate(log, F.lit(0), lambda at, x: at + F.when(F.get(want, at).eqNullSafe(x), 1).otherwise(0)) >= len(expected)
