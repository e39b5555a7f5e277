"""Running sums inside a key that may hold very many rows: in blocks of places, then over the blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of one block.
BLOCK = 4096


def running_sum(df: DataFrame, key: str, place: str, then: list[Column], value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the key up to this one, in order of ``place`` (a whole number) and ``then``.

    A window holds the rows of a block only; the sums of the blocks before come from a table of a row a block. So a key with a third of all
    rows is spread over as many tasks as it has blocks.
    """
    at = df.withColumns({"__block": F.floor(F.col(place) / block), "__value": value})
    sums = at.groupBy(key, "__block").agg(F.sum("__value").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(key, "__block", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.sum("__value").over(Window.partitionBy(key, "__block").orderBy(place, *then).rowsBetween(Window.unboundedPreceding, 0))
    return at.join(offsets, [key, "__block"]).withColumn(name, F.col("__before") + inside).drop("__block", "__value", "__before")
