"""Global positions and totals over an order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventledger.session import written

_ROW_BITS = 33  # of monotonically_increasing_id: the row within a partition


def _ordered(rows: DataFrame, keys: Sequence[str], parts: int | None) -> DataFrame:
    """Range partitions in the order of ``keys``, each sorted."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


def _offsets(spans: DataFrame, group: Sequence[str]) -> DataFrame:
    """Adds ``_before``, the sum of ``_n`` over earlier partitions of the same group.

    There is one row for each partition and group in it: as many as partitions and groups.
    """
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("bigint")))


def _placed(spans: DataFrame, group: Sequence[str]) -> DataFrame:
    """``_offsets``, broadcast without groups: it is a row for each partition then, which the
    planner cannot know, and a shuffled join would move all rows again."""
    offsets = _offsets(spans, group)
    return offsets if group else F.broadcast(offsets)


def number_rows(
    rows: DataFrame, order: Sequence[str], group: Sequence[str] = (), name: str = "position", parts: int | None = None
) -> DataFrame:
    """Adds ``name``: 0, 1, 2 … without gaps in the order of the columns ``order``, from 0 again
    for each ``group``.

    The rows are range-partitioned and staged once; a row's place in its partition and the
    counts of the partitions before it give its number. Rows with equal ``order`` are
    numbered in no particular order. Group columns must not be null.
    """
    numbered = _ordered(rows, [*group, *order], parts).selectExpr("*", "monotonically_increasing_id() AS _place")
    staged = written(numbered, "numbering").selectExpr("*", f"shiftright(_place, {_ROW_BITS}) AS _part")
    spans = staged.groupBy("_part", *group).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    placed = staged.join(_placed(spans, group), ["_part", *group])
    return placed.select(*(c for c in rows.columns), (F.col("_place") - F.col("_first") + F.col("_before")).alias(name))


def totals_before(
    rows: DataFrame, order: Sequence[str], value: str, group: Sequence[str] = (), name: str = "before", parts: int | None = None
) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of a ``group`` that come before in ``order``.

    ``order`` must tell the rows of a group apart. Group columns must not be null.
    """
    marked = _ordered(rows, [*group, *order], parts).withColumn("_part", F.spark_partition_id())
    staged = written(marked, "totals")
    spans = staged.groupBy("_part", *group).agg(F.sum(value).alias("_n"))
    within = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = staged.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0).cast("bigint")))
    placed = local.join(_placed(spans, group).select("_part", *group, "_before"), ["_part", *group])
    return placed.select(*rows.columns, (F.col("_within") + F.col("_before")).alias(name))
