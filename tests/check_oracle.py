"""Compare queries with their SQL: ``python tests/check_oracle.py [sf_dir] [name …]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def frame(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows by value."""
    df = df[sorted(df.columns)].copy()
    for name in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[name]):
            df[name] = df[name].astype("datetime64[us]")
        elif df[name].dtype == object or str(df[name].dtype).startswith("str"):
            df[name] = df[name].astype(object).where(df[name].notna(), None)
    return df.sort_values(list(df.columns), na_position="first", kind="stable").reset_index(drop=True)


def sql_result(sf_dir: str, sql: str) -> pd.DataFrame:
    with duckdb.connect() as db:
        for file in Path(sf_dir).glob("*.parquet"):
            db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
        return db.execute(sql).df()


def differences(spark, sf_dir: str, name: str, query, sql: str) -> str | None:
    """None when the query and its SQL give the same rows, else what differs."""
    got, want = frame(query(spark, sf_dir).toPandas()), frame(sql_result(sf_dir, sql))
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} != {list(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    try:
        pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)
    except AssertionError as error:
        return str(error)
    kinds = [(n, str(a), str(b)) for n, a, b in zip(got.columns, got.dtypes, want.dtypes) if str(a) != str(b)]
    return f"types {kinds}" if kinds else None


def main() -> None:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or oracle:
        start = time.perf_counter()
        result = differences(spark, sf_dir, name, queries[name], oracle[name])
        print(f"{'ok  ' if result is None else 'DIFF'} {name} {time.perf_counter() - start:.1f}s {result or ''}", flush=True)


if __name__ == "__main__":
    main()
