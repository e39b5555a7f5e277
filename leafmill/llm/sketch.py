"""Operator 7, document fingerprints: threshold-scaled sketches in DataFrame functions only.

A sketch keeps every 5-word shingle hash in the lowest ``1 / scale`` of the 64-bit range. So the sketch of a long text and
that of a short one are samples at the same rate: the share of one that the other holds estimates containment however
unequal they are, and the sketch of a union is the union of the sketches.

Words are runs of ASCII letters, digits and characters beyond ASCII, lower-cased. Defined results: a null text counts
as empty; a text of fewer than five words is one shingle of them; a text without words is one shingle of its
characters. A text none of whose hashes is low enough has its least hash for a sketch, which lies above the threshold;
``merged`` drops it where a true member exists, and the likeness of such a (short) text is the exact share of its shingles that the other text has.
Texts of any length are held whole by one task, about 20 bytes a word beside the text. Equal texts have equal sketches. Null doc_ids come last in the order of documents, ties
go by the text's hash. In a table of one row that row is its own next. An empty table gives an empty result. Extra
columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class SketchParams:
    """``bucket_rows``: about so many neighbouring documents share a window partition; beyond ``buckets`` of them they grow."""

    scale: int = 8
    bucket_rows: int = 4096
    buckets: int = 16_384


def threshold(scale: int) -> int:
    return -(1 << 63) + (1 << 64) // scale


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(text), _BETWEEN), ""), lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, text: Column) -> Column:
    """The hashes of all shingles, from the word hashes; never empty."""
    shingle = lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WORDS)])
    many = F.transform(hashes, shingle)
    few = F.array(F.when(F.size(hashes) > 0, F.xxhash64(hashes)).otherwise(F.xxhash64(text)))
    return F.when(F.size(hashes) >= WORDS, F.slice(many, F.lit(1), F.greatest(F.lit(1), F.size(hashes) - WORDS + 1))).otherwise(few)


def retained(every: Column, scale: int) -> Column:
    low = F.filter(every, lambda h: h < threshold(scale))
    return F.array_sort(F.array_distinct(F.when(F.size(low) > 0, low).otherwise(F.array(F.array_min(every)))))


def with_sketch(df: DataFrame, text: str, name: str, scale: int) -> DataFrame:
    """Adds the sketch of a text column; each step is its own projection so that no step runs once for each element."""
    out = df.withColumn("__hashes", word_hashes(F.coalesce(F.col(text), F.lit(""))))
    out = out.withColumn("__every", shingle_hashes(F.col("__hashes"), F.coalesce(F.col(text), F.lit("")))).drop("__hashes")
    return out.withColumn(name, retained(F.col("__every"), scale)).drop("__every")


def fingerprint(sketch: Column) -> Column:
    """Hexadecimal digits of the sketch, 16 for each hash, in order."""
    return F.concat(F.size(sketch).cast("string"), F.lit(":"), F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has."""
    return F.size(F.array_intersect(a, b)) / F.size(a).cast("double")


def likeness(df: DataFrame, name: str, other_text: str, other: str, scale: int) -> DataFrame:
    """Adds the share of the shingles of ``text`` that another text has: by the sketches, or by all shingles where the own sketch holds none below the threshold.

    The shingles of such a text are fewer than a few times ``scale``; those of the other text are made for these rows only.
    """
    short = F.array_min("sketch") >= threshold(scale)
    own = lambda c: F.when(short, c)
    df = df.withColumns({"__mine": own(word_hashes(F.col("text"))), "__theirs": own(word_hashes(F.col(other_text)))})
    df = df.withColumns({"__mine": own(F.array_distinct(shingle_hashes(F.col("__mine"), F.col("text")))), "__theirs": own(shingle_hashes(F.col("__theirs"), F.col(other_text)))})
    return df.withColumn(name, F.when(short, containment(F.col("__mine"), F.col("__theirs"))).otherwise(containment(F.col("sketch"), F.col(other)))).drop("__mine", "__theirs")


def merged(sketch: Column, scale: int) -> Column:
    """Aggregate: the sketch of all the texts together."""
    every = F.array_distinct(F.flatten(F.collect_set(sketch)))
    low = F.filter(every, lambda h: h < threshold(scale))
    return F.array_sort(F.when(F.size(low) > 0, low).otherwise(F.array(F.array_min(every))))


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the id, found in two steps; null ids come last."""
    if not bounds:
        return F.when(doc_id.isNull(), 1).otherwise(0)
    width = 128
    outer = bounds[::width]
    lists = ", ".join(f"array({', '.join(f'{x}L' if x > -(1 << 63) else 'bigint(-9223372036854775808)' for x in bounds[i : i + width])})" for i in range(0, len(bounds), width))
    first = F.size(F.filter(F.expr(f"array({', '.join(f'bigint({x})' for x in outer)})"), lambda b: b <= doc_id))
    inside = F.size(F.filter(F.element_at(F.expr(f"array({lists})"), first), lambda b: b <= doc_id))
    return F.when(doc_id.isNull(), len(bounds) + 1).when(first == 0, 0).otherwise((first - 1) * width + inside)


def with_next(documents: DataFrame, params: SketchParams, carried: list[str]) -> DataFrame:
    """Each row with the ``carried`` columns of the next document by ascending doc_id as next_<name>; after the last, the first.

    Ids are dealt to buckets of about equal numbers of neighbours by approximate quantiles. Of each bucket the
    first document is copied to the end of the bucket before it, so that one window over buckets sees every
    next document; the table of first ids has at most ``buckets`` + 2 rows.
    """
    ids = documents.select("doc_id")
    n = ids.count()
    k = min(params.buckets, n // params.bucket_rows)
    if k > 1:
        shares = ", ".join(f"{i / k!r}D" for i in range(1, k))
        bounds = ids.select(F.expr(f"percentile_approx(doc_id, array({shares}), {max(10_000, 4 * k)})")).first()[0]
    else:
        bounds = []
    bounds = sorted(set(bounds or []))
    bucket = _bucket(F.col("doc_id"), bounds)
    firsts = [(r["b"], r["id"]) for r in ids.withColumn("b", bucket).groupBy("b").agg(F.min("doc_id").alias("id")).orderBy("b").collect()]
    before = [(i, firsts[j - 1][0]) for j, (_, i) in enumerate(firsts)] or [(None, 0)]
    copies = F.broadcast(documents.sparkSession.createDataFrame(before, "first_id long, to_bucket int"))
    placed = documents.join(copies, F.col("doc_id").eqNullSafe(F.col("first_id")), "left").withColumn("__own", F.struct(bucket.cast("int").alias("bucket"), F.lit(False).alias("extra")))
    both = placed.withColumn("__at", F.explode(F.when(F.col("to_bucket").isNull(), F.array("__own")).otherwise(F.array("__own", F.struct(F.col("to_bucket").alias("bucket"), F.lit(True).alias("extra"))))))
    order = Window.partitionBy("__at.bucket").orderBy(F.col("__at.extra"), F.col("doc_id").asc_nulls_last(), F.col("__tie"))
    out = both.drop("__own", "first_id", "to_bucket").withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return out.where("NOT __at.extra").drop("__at")


def fingerprints(documents: DataFrame, params: SketchParams = SketchParams()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_hashes for each row."""
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = with_sketch(own, "text", "sketch", params.scale).withColumn("__tie", F.xxhash64("text"))
    near = with_next(own, params, ["text", "sketch"])
    n = F.length("text")
    near = near.withColumn("n_chars", n).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - F.col("half")), F.substring("next_text", F.lit(1), F.col("half")))
    near = likeness(near.withColumn("edited", edited), "near_next", "next_text", "next_sketch", params.scale).drop("next_text", "next_sketch")
    near = likeness(with_sketch(near, "edited", "edited_sketch", params.scale), "near_edited", "edited", "edited_sketch", params.scale).drop("text")
    return near.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.size("sketch").cast("long").alias("n_hashes"),
    )
