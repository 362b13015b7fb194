"""A file order in which several columns are each kept close: bits of their ranks, interleaved.

Rows sorted by one column let a scan skip files for filters on that column only. Sorted by
interleaved bits, each column's values stay within few files, so that the files' own
minima and maxima rule out most of them for a filter on any of the columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANK_BITS = 6  # of a column's rank: 64 steps


def boundaries(rows: DataFrame, name: str, steps: int = 1 << RANK_BITS) -> list:
    """At most ``steps`` values that cut a column into parts of about equal size, ascending."""
    values = rows.select(name).where(F.col(name).isNotNull()).repartitionByRange(steps, name)
    least = values.groupBy(F.spark_partition_id()).agg(F.min(name).alias("least")).collect()
    return sorted({row["least"] for row in least})


def rank(name: str, bounds: Sequence, bits: int = RANK_BITS) -> Column:
    """Which part a value lies in, spread over all numbers of ``bits`` bits; null is 0."""
    if not bounds:
        return F.lit(0)
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda bound: bound <= F.col(name)))
    return F.when(F.col(name).isNull(), 0).otherwise(F.floor(part * ((1 << bits) - 1) / F.lit(len(bounds))).cast("int"))


def interleaved(ranks: Sequence[Column], bits: int = RANK_BITS) -> Column:
    """One number whose bits take turns among the ranks', the highest first."""
    code = F.lit(0).cast("long")
    for bit in range(bits):
        for at, value in enumerate(ranks):
            place = bit * len(ranks) + len(ranks) - 1 - at
            one = F.shiftright(value, bit).bitwiseAND(F.lit(1)).cast("long")
            code = code.bitwiseOR(F.shiftleft(one, place))
    return code


def clustered(rows: DataFrame, names: Sequence[str], files: int) -> DataFrame:
    """``rows`` in ``files`` partitions, close in all columns ``names`` at once."""
    code = interleaved([rank(name, boundaries(rows, name)) for name in names])
    coded = rows.withColumn("_code", code)
    return coded.repartitionByRange(files, "_code", *names).sortWithinPartitions("_code", *names).drop("_code")
