"""Raw messages from a landing folder or a Kafka cluster, unfiltered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventledger.schema import RAW_SCHEMA


def raw_message_source(
    spark: SparkSession,
    path: str,
    fmt: str = "json",
    streaming: bool = True,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: int | str | None = None,
    extra: T.StructType | None = None,
) -> DataFrame:
    """Every message in a landing folder; no routing-key predicate is applied.

    ``json`` and ``parquet`` files hold ``RAW_SCHEMA`` (plus ``extra`` fields); ``text``
    files hold one body per line and take their receipt time from the file. ``arrival_seq``
    may be NULL; ingest then orders by position. ``max_files_per_trigger`` bounds a
    micro-batch the way a prefetch count bounds a consumer; ``max_bytes_per_trigger`` bounds
    it by size instead: files are taken until the next one would exceed it, so a file that
    is larger by itself makes a batch of its own.
    """
    if max_files_per_trigger and max_bytes_per_trigger:
        raise ValueError("a micro-batch is bounded by files or by bytes")
    reader = spark.readStream if streaming else spark.read
    if streaming and max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "text":
        lines = reader.format("text").load(path)
        return lines.select(
            F.col("value").alias("body"),
            F.lit(None).cast("string").alias("routing_key"),
            F.col("_metadata.file_modification_time").alias("received_at"),
            F.lit(None).cast("bigint").alias("arrival_seq"),
        )
    fields = RAW_SCHEMA.fields + (extra.fields if extra else [])
    if fmt != "json":
        return reader.format(fmt).schema(T.StructType(fields)).load(path)
    # A line that is no message keeps its text, as the body that will be rejected.
    broken = T.StructField("_broken", T.StringType())
    lines = reader.format("json").option("columnNameOfCorruptRecord", "_broken").schema(T.StructType([*fields, broken])).load(path)
    return lines.withColumn("body", F.coalesce("body", "_broken")).drop("_broken")


def kafka_message_source(
    spark: SparkSession,
    servers: str,
    topic_pattern: str = ".*",
    max_offsets_per_trigger: int | None = None,
    **options: str,
) -> DataFrame:
    """Every record of every matching topic. Needs the Kafka connector on the classpath.

    Offsets repeat over topics and partitions, so both stay beside them: the ingest then
    orders by receipt, topic, partition and offset.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribePattern", topic_pattern)
        .option("startingOffsets", "earliest")
        .options(**options)
    )
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return reader.load().select(
        F.col("value").cast("string").alias("body"),
        F.col("key").cast("string").alias("routing_key"),
        F.col("timestamp").alias("received_at"),
        F.col("offset").alias("arrival_seq"),
        F.col("topic"),
        F.col("partition"),
    )
