"""Numbers of 64 bits for 128-bit digests, with those that would coincide hashed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.plans.scratch import materialize


def _number() -> Column:
    return F.xxhash64("digest")


class Numbers:
    """Numbers of the digests of a stored table that has each digest once.

    A digest's number is 64 bits of it.  Where several digests have the same
    ones, which some pairs among 10^10 do, all but the least are hashed again; that
    a number so made is taken too is possible, but not expected (1 in 10^8 at 10^10).
    The table of shared numbers, about n * n / 2^65 rows (3 at 10^10, 27,000 at
    10^12), goes to all tasks.
    """

    def __init__(self, distinct: DataFrame):
        shared = distinct.select(_number().alias("class")).groupBy("class").agg(F.count("*").alias("n")).filter("n > 1").select("class")
        shared = materialize(shared, "shared-numbers")
        self.shared: DataFrame | None = None
        if not shared.isEmpty():
            least = distinct.select(_number().alias("class"), "digest").join(F.broadcast(shared), "class").groupBy("class").agg(F.min("digest").alias("_least"))
            self.shared = materialize(least, "shared-numbers")

    def add(self, rows: DataFrame) -> DataFrame:
        """rows with a column class, the number of their digest."""
        rows = rows.withColumn("class", _number())
        if self.shared is None:
            return rows
        again = F.col("_least").isNotNull() & (F.col("_least") != F.col("digest"))
        own = F.when(again, F.xxhash64("digest", F.lit(1))).otherwise(F.col("class"))
        return rows.join(F.broadcast(self.shared), "class", "left").withColumn("class", own).drop("_least")
