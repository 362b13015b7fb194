"""A store and a landing folder built from an events table, once per application.

Queries over a store need one that was filled by the real ingest; building it anew for
each of them would only repeat the same work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from eventledger.plans.ingest import ingest_batch
from eventledger.plans.store import EventStore
from eventledger.session import prepare, shared_dir
from eventledger.sources.messages import raw_message_source
from eventledger.sources.sample import load_events, messages_from_events

PROCESSED_AT = T.StructType([T.StructField("processed_at", T.TimestampType())])

_built: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, build):
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of the events table, derived on the fly."""
    return messages_from_events(load_events(prepare(spark), sf_dir))


def filled_store(spark: SparkSession, sf_dir: str) -> EventStore:
    """A store that holds every message of the events table; do not write to it."""

    def build() -> EventStore:
        store = new_store(spark, "store")
        ingest_batch(messages(spark, sf_dir), store, stored_at="processed_at")
        return store

    return _once(prepare(spark), sf_dir, "store", build)


def new_store(spark: SparkSession, label: str) -> EventStore:
    return EventStore(spark, shared_dir(spark, label)).init()


def landing(spark: SparkSession, sf_dir: str) -> str:
    """A folder of JSON files with every message of the events table."""

    def build() -> str:
        path = shared_dir(spark, "landing")
        messages(spark, sf_dir).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
        return path

    return _once(prepare(spark), sf_dir, "landing", build)


def message_stream(
    spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """The landing folder as a stream."""
    return raw_message_source(
        spark,
        landing(spark, sf_dir),
        max_files_per_trigger=max_files_per_trigger,
        extra=PROCESSED_AT,
    )
