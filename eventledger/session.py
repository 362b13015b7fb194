"""Session settings, the shared work folder and plan-size estimates."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    # Stored instants are UTC; event_date is their UTC day.
    "spark.sql.session.timeZone": "UTC",
    # A JSON object that names a key twice keeps the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings every operator relies on. Cheap and repeatable."""
    for key, value in SESSION_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder, not yet made, that every executor can reach.

    It lies under ``spark.checkpoint.dir`` when the cluster names one. Only a local
    master, where driver and executors share one machine, may fall back to a
    temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        path = f"{base.rstrip('/')}/eventledger/{label}-{uuid.uuid4().hex}"
    elif spark.conf.get("spark.master", "").startswith("local"):
        path = f"{tempfile.gettempdir()}/eventledger-{label}-{uuid.uuid4().hex}"
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    if not _made:
        atexit.register(_remove_made, spark)
    _made.append(path)
    return path


_made: list[str] = []


def _remove_made(spark: SparkSession) -> None:
    """Work folders last as long as the application; results read from them do too."""
    try:
        conf = spark._jsc.hadoopConfiguration()
        for name in _made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # the session is gone already
        return


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, any executor may go."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate for ``df``, or None when it is out of reach."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except AttributeError:  # Spark Connect has no local plan
        return None
