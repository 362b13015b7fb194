"""What several operators share: words, typed column choice, partition counts."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventledger.session import estimated_bytes, written  # noqa: F401  used by the operators from here

#: Word separators, the same set as ``bytes.split()`` without an argument.
SPACE = r"[\x20\x09-\x0D]+"
NO_ID = (1 << 63) - 1  # stands for a null id: sorts behind all others
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def text_tag(name: str = "text") -> Column:
    """Tells rows that share an id apart when their texts differ."""
    return F.hash(F.col(name))


def partitions_for(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Shuffle partitions: the session's setting, or more when the input is known to be large."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = estimated_bytes(df) or 0
    known = size < 1 << 60  # Spark's guess for what it knows nothing about is beyond
    return max(least, math.ceil(size / bytes_each)) if known else least


def mix(x):
    """Spreads numpy uint64 values over all their bits."""
    import numpy as np

    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
