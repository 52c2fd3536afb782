"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.plans.scratch import materialize

#: Rows of one key above which they aren't brought together.
HOT_ROWS = 100_000


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: int = HOT_ROWS) -> DataFrame:
    """left joined (inner or left) with right, which has one row for each key.

    Keys with more than `hot` rows, of which there are fewer than the rows of
    left by `hot`, are sent with their row of right to all tasks, and their rows
    stay where they are; the others meet in a shuffle.  left is read three
    times, so it should be a stored table.  Rows with a null key have no match.
    """
    many = materialize(left.groupBy(key).agg(F.count("*").alias("_n")).filter((F.col("_n") > hot) & F.col(key).isNotNull()).select(key), "hot-keys")
    if many.isEmpty():
        return left.join(right, key, how)
    few = right.join(F.broadcast(many), key, "left_semi")
    at_home = left.join(F.broadcast(many), key, "left_semi").join(F.broadcast(few), key, how)
    return at_home.unionByName(left.join(F.broadcast(many), key, "left_anti").join(right, key, how))
