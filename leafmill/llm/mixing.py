"""Operator 10, mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / w, u a uniform number made of its id and w its quality weight; ordered by key, a source's
documents are a weighted sample without replacement. A source whose target exceeds its size first takes complete epochs;
what remains is a fractional selection of the documents of least key, whose sizes add up to the budget.

Nothing is sorted whole. Keys are counted in a grid for each source; only the cell that holds the budget is divided
further, until it has ``block`` rows at most, and just those are sorted and summed. The outcome for a source is
one threshold (key, id, size); whether a document is taken follows from its own row and its source's threshold.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own, last in order; a null doc_id
draws by its text's md5. Rows equal in key, id and size stand or fall together. The document at which the budget is
crossed is taken if that comes nearer to the target. An empty table gives an empty result; if all sizes are 0, all
targets are 0. Extra columns are kept by ``repeat_rows``; names that start with ``__mix`` are the operator's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm._batches import with_checkpoints

#: What separates words: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters that are rare in prose.
ODD = "#$%&*!|{}<>[]^~_@+=\\"
#: Sources beyond which their table is not broadcast.
BROADCAST_SOURCES = 10_000


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    cap: int = 2
    seed: str = "mix"
    grid: int = 4096
    block: int = 2_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """From 0.1 to 1: falls by 4 for each part of the text that odd characters take."""
    n = F.length(text)
    odd = n - F.length(F.translate(text, ODD, ""))
    return F.when(n > 0, F.greatest(F.lit(0.1), 1 - 4.0 * odd / n)).otherwise(0.1)


def draw_key(doc_id: Column, text: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight; u has 52 bits of the md5 of the seed and the id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.md5(text), F.lit("")))), 1, 13), 16, 10).cast("long")
    return -F.log((bits + 0.5) / float(1 << 52)) / weight


def features(documents: DataFrame, params: MixParams) -> DataFrame:
    """__mix_id, __mix_source, __mix_size, __mix_key besides the columns of ``documents``; codegen only."""
    text, doc_id = documents["text"], documents["doc_id"]
    return documents.withColumns({"__mix_size": size_of(text), "__mix_key": draw_key(doc_id, text, quality_weight(text), params.seed)})


def targets(narrow: DataFrame, params: MixParams) -> DataFrame:
    """source, source_size, target of each source: a share by weight, capped, the excess shared again.

    In order of cap to weight, the capped sources come first; a source is capped if what is left before it, shared
    by the weights from it on, reaches its cap. One row a source, so a single window is enough.
    """
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in params.weights]), (rank % len(params.weights) + 1).cast("int"))
    by = sources.withColumn("weight", weight).withColumn("top", F.col("source_size") * params.cap)
    rising = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.sum("top").over(rising.rowsBetween(Window.unboundedPreceding, -1))
    left = params.share * F.sum("source_size").over(everything) - F.coalesce(before, F.lit(0))
    by = by.withColumn("level", left / F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("capped", F.col("top") / F.col("weight") <= F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return by.select("source", "source_size", F.when(F.col("capped"), F.col("top").cast("double")).otherwise(level * F.col("weight")).alias("target"))


def thresholds(narrow: DataFrame, params: MixParams) -> DataFrame:
    """For each source: source_size, target, epochs and the last (key, id, size) that the fraction takes; null if none.

    ``narrow``: doc_id, source, size, key.
    """
    goal = targets(narrow, params).withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(params.cap))).otherwise(0).cast("long"))
    goal = goal.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    ranges = narrow.groupBy("source").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("held"))
    cells = small(goal.join(ranges.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_").withColumn("before", F.lit(0).cast("long")).checkpoint())
    for _ in range(12):
        if cells.where((F.col("held") > params.block) & (F.col("high") > F.col("low"))).isEmpty():
            break
        inside = within(narrow, cells)
        cell = F.least(F.lit(params.grid - 1), F.floor((F.col("key") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-300)) * params.grid)).cast("int")
        sums = inside.withColumn("cell", cell).groupBy("source", "cell").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.withColumn("upto", F.coalesce(upto, F.lit(0))).withColumnRenamed("source", "source_")
        placed = sums.join(cells, F.col("source").eqNullSafe(F.col("source_"))).where(F.col("before") + F.col("upto") <= F.col("budget"))
        last = placed.groupBy("source", "source_size", "target", "epochs", "budget").agg(F.max(F.struct("cell", "least", "most", "n", (F.col("before") + F.col("upto")).alias("now"))).alias("l"))
        cells = small(last.select("source", "source_size", "target", "epochs", "budget", F.col("l.least").alias("low"), F.col("l.most").alias("high"), F.col("l.n").alias("held"), F.col("l.now").alias("before")).checkpoint())
    by = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")
    run = F.sum("size").over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    peers = F.sum("size").over(Window.partitionBy("source", "key", "doc_id", "size"))
    summed = within(narrow, cells).withColumn("run", F.col("before") + run).withColumn("peers", peers)
    taken = summed.where(F.col("run") - F.col("peers") / 2.0 <= F.col("budget"))
    edge = taken.groupBy(F.col("source").alias("source_")).agg(F.max(F.struct("key", "doc_id", "size")).alias("last"))
    edge = edge.join(cells.select("source", "low"), F.col("source").eqNullSafe(F.col("source_")), "right").select("source", "low", "last")
    out = cells.drop("low", "high", "held", "before", "budget").join(edge.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    return small(out.checkpoint())


def small(table: DataFrame) -> DataFrame:
    """Broadcast a table of one row a source if it has few rows; else joins shuffle, and adaptive execution splits hot sources."""
    return F.broadcast(table) if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else table


def within(narrow: DataFrame, cells: DataFrame) -> DataFrame:
    """The rows whose key lies in their source's cell, with the cell's columns."""
    joined = narrow.withColumnRenamed("source", "source_").join(cells, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    return joined.where(F.col("key").between(F.col("low"), F.col("high")))


def decided(rows: DataFrame, edge: DataFrame) -> DataFrame:
    """Adds source_size, target and repeats (how often each row is taken). ``rows``: doc_id, source, __mix_size, __mix_key and others."""
    edge = edge.select(F.col("source").alias("__mix_source"), F.col("source_size").alias("__mix_source_size"), F.col("target").alias("__mix_target"), "epochs", "low", "last")
    joined = rows.join(small(edge), F.col("source").eqNullSafe(F.col("__mix_source")), "left")
    own = F.struct(F.col("__mix_key").alias("key"), rows["doc_id"].alias("doc_id"), F.col("__mix_size").alias("size"))
    chosen = F.coalesce((F.col("__mix_key") < F.col("low")) | (own <= F.col("last")), F.lit(False))
    return joined.withColumn("__mix_repeats", F.col("epochs") + chosen.cast("long")).drop("__mix_source", "epochs", "low", "last")


def narrow_of(documents: DataFrame, params: MixParams) -> DataFrame:
    with_checkpoints(documents.sparkSession)
    return features(documents.select("doc_id", "source", "text"), params).select("doc_id", "source", F.col("__mix_size").alias("size"), F.col("__mix_key").alias("key")).checkpoint()


def mix(documents: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``documents``."""
    narrow = narrow_of(documents, params)
    got = decided(narrow.withColumnsRenamed({"size": "__mix_size", "key": "__mix_key"}), thresholds(narrow, params))
    return got.select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), (F.col("__mix_size") * F.col("__mix_repeats")).alias("taken"))


def repeat_rows(documents: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The mixture: each row of ``documents`` as often as it is taken, its columns unchanged. Rows of size 0 go."""
    edge = thresholds(narrow_of(documents, params), params)
    got = decided(features(documents, params), edge).where("__mix_size > 0 AND __mix_repeats > 0")
    return got.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_repeats")))).select(documents.columns)


def oracle(params: MixParams = MixParams()) -> str:
    """DuckDB SQL for ``mix`` over the table ``documents``."""
    odd = ODD.replace("'", "''")
    weights = ", ".join(map(str, params.weights))
    return rf"""
WITH d AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
    CASE WHEN length(text) > 0 THEN greatest(0.1::DOUBLE, 1 - 4.0::DOUBLE * (length(text) - length(translate(text, '{odd}', ''))) / length(text)) ELSE 0.1::DOUBLE END AS w,
    (CAST('0x' || substr(md5('{params.seed}' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / w AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
r AS (SELECT *, ([{weights}])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(params.weights)} + 1)::INT] AS weight FROM s),
c AS (SELECT *, {params.cap} * source_size AS top FROM r),
l AS (SELECT *, ({params.share}::DOUBLE * sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY top::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM c),
f AS (SELECT *, top::DOUBLE / weight <= level AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN top::DOUBLE ELSE max(CASE WHEN NOT capped THEN level END) OVER () * weight END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size)::BIGINT, {params.cap}) ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST, k.size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
    sum(k.size) OVER (PARTITION BY k.source, k.key, k.doc_id, k.size) AS peers
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN run - peers / 2.0 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""
