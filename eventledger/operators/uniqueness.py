"""First write wins per event id.

One id may hold a large share of all messages, so nothing here gathers an id's rows
in one task: both paths reduce each id to one candidate before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_by_id(
    rows: DataFrame, key: str = "id", order: tuple[str, ...] = ("arrival_seq",)
) -> DataFrame:
    """The first row of each id; NULLs come first, rows of equal order by a hash of all they hold.

    ``row_number() = 1`` makes Spark put a window group limit before the exchange: a task
    sends one row per id, however often the id occurs.
    """
    window = Window.partitionBy(key).orderBy(*order, _tie(rows))
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def _tie(rows: DataFrame) -> Column:
    """The same order among rows of equal position wherever they are compared."""
    return F.xxhash64(*rows.columns)


def first_writes(
    rows: DataFrame, key: str = "id", order: tuple[str, ...] = ("arrival_seq",)
) -> DataFrame:
    """``key`` and the ``order`` columns of its first row; partial minima are shuffled."""
    first = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    return first.select(key, *[F.col("_first")[name].alias(name) for name in order])


def duplicate_rejects(
    rows: DataFrame, key: str = "id", order: tuple[str, ...] = ("arrival_seq",)
) -> DataFrame:
    """The rows ``unique_by_id`` leaves out; the two are complements of ``rows``.

    Each id's first position is found with partial minima. A row is a winner when it stands
    there; the join uses the position as well as the id, so the copies of a hot id spread
    over all partitions. Among rows that are equal in all columns the first is the winner.
    """
    # One struct holds id and position: it is never null itself, nulls within it are equal, and
    # the numbering and the join partition by the same column, so rows are shuffled once.
    placed = rows.withColumn("_at", F.struct(key, *order, _tie(rows).alias("_tie")))
    firsts = placed.groupBy(key).agg(F.min("_at").alias("_first")).select("_first")
    numbered = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_at").orderBy("_at")))
    wins = (F.col("_at") == F.col("_first")) & (F.col("_n") == 1)
    return numbered.join(firsts, wins, "left_anti").drop("_at", "_n")
