"""Rows that belong together in one task: one exchange, one sort, and a fold in Python over each group; groups too large for a task's memory are told first."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from leafmill.session import with_checkpoints

#: Groups beyond so many rows or bytes of text go another way; what holds their keys is as small as all rows divided by this.
MOST_ROWS, MOST_BYTES = 10_000, 32 << 20
#: Rows and characters that a step gives back at a time.
STEP_ROWS, STEP_CHARS = 10_000, 4 << 20
#: Bytes of an Arrow batch that Spark sends to Python at most, unless a single row is longer.
BATCH_BYTES = 8 << 20


def split_groups(tables: list[tuple[DataFrame, str | None]], by: list[str]) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """(small, large) of each table by its group's rows and text in all tables together; ``large`` is None where there are no such groups. ``tables``: each with the name of its text."""
    with_checkpoints(tables[0][0].sparkSession)
    sized = [df.select(*by, (F.coalesce(F.octet_length(text), F.lit(0)) if text else F.lit(0)).cast("long").alias("n")) for df, text in tables]
    every = sized[0]
    for df in sized[1:]:
        every = every.unionByName(df)
    known = " AND ".join(f"{c} IS NOT NULL" for c in by)  # an unknown group has no rows that belong together
    large = every.where(known).groupBy(*by).agg(F.count("*").alias("rows"), F.sum("n").alias("n")).where((F.col("rows") > MOST_ROWS) | (F.col("n") > MOST_BYTES)).select(*by).checkpoint()
    if large.isEmpty():
        return [df for df, _ in tables], None
    return [df.join(F.broadcast(large), by, "left_anti") for df, _ in tables], [df.join(F.broadcast(large), by, "left_semi") for df, _ in tables]


def map_groups(df: DataFrame, by: list[str], schema: StructType, work: Callable[[tuple, list[tuple]], Iterable[tuple]]) -> DataFrame:
    """``work(key, rows)`` of each group, whose rows are the columns behind ``by``; they come in no order. Of a group with a null in its key it gets some rows at a time."""
    n, others = len(by), [c for c in df.columns if c not in by]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        at, held, made, chars = None, [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)

        for part in batches:
            for row in zip(*[c.to_pylist() for c in part.columns]):
                if row[:n] != at or (len(held) >= STEP_ROWS and None in at):
                    for x in work(at, held) if held else ():
                        made.append(x)
                        chars += sum(len(v) for v in x if isinstance(v, str))
                        if len(made) >= STEP_ROWS or chars >= STEP_CHARS:
                            yield batch()
                            made, chars = [], 0
                    at, held = row[:n], []
                held.append(row[n:])
        made.extend(work(at, held) if held else ())
        if made:
            yield batch()

    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int("".join(c for c in spark.conf.get(key) if c.isdigit())) not in range(1, BATCH_BYTES + 1):
        spark.conf.set(key, str(BATCH_BYTES))
    return df.select(*by, *others).repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


class Titles:
    """Headings of one group, looked up by their keys, else by the words that keys share: four fifths at least, the best and then the first."""

    def __init__(self, headings: Iterable[tuple[object, str | None]]):
        self.first: dict[str, object] = {}
        for i, key in headings:
            if key is not None:
                held = self.first.get(key)
                self.first[key] = i if held is None else held if i is None else min(i, held)
        self.sets: list[tuple[set[str], object]] | None = None
        self.found: dict[str, object] = {}

    def look(self, key: str | None):
        if key is None:
            return None
        same = self.first.get(key)
        if same is not None:
            return same
        if key not in self.found:
            self.found[key] = self._like(set(key.split()))
        return self.found[key]

    def _like(self, words: set[str]):
        if not words:
            return None
        if self.sets is None:
            self.sets = [(set(k.split()), i) for k, i in self.first.items()]
            self.holds: dict[str, list[int]] = {}
            if len(self.sets) > 24:
                for at, (other, _) in enumerate(self.sets):
                    for w in other:
                        self.holds.setdefault(w, []).append(at)
        n = len(words)
        near: Iterable[int] = range(len(self.sets))
        if self.holds:
            # of two sets that are alike each n - 4n/5 + 1 words of the one hold a word of the other; the rarest here find the fewest
            rare = sorted(words, key=lambda w: len(self.holds.get(w, ())))[: n - (4 * n + 4) // 5 + 1]
            near = {at for w in rare for at in self.holds.get(w, ())}
        best = None
        for at in near:
            other, i = self.sets[at]
            m = len(other)
            if 5 * m >= 4 * n and 5 * n >= 4 * m:
                shared = len(words & other)
                if 5 * shared >= 4 * (n + m - shared):
                    rank = (-shared / (n + m - shared), i is not None, i)
                    if best is None or rank[:2] < best[:2] or (rank[:2] == best[:2] and i is not None and i < best[2]):
                        best = rank
        return best and best[2]
