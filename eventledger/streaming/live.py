"""Counters that grow with the stream, and the feed of stored events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from eventledger.operators import metrics
from eventledger.operators.envelopes import normalize_envelope
from eventledger.plans.store import EventStore
from eventledger.streaming.ingest import _trigger


def live_received(raw: DataFrame) -> DataFrame:
    return metrics.events_received_total(normalize_envelope(raw))


def live_stored(store: EventStore) -> DataFrame:
    return metrics.events_stored_total(store.tail())


def live_failed(store: EventStore) -> DataFrame:
    return metrics.events_failed_total(store.quarantine_tail())


def publish_counters(
    counters: DataFrame, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Start keeping the current counts under ``path``, one version per batch.

    Every version is complete (as many rows as there are label values), so a reader
    takes the newest one: see ``read_counters``.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        # A reader may still be at the version before; older ones go.
        jvm, conf = batch.sparkSession._jvm, batch.sparkSession._jsc.hadoopConfiguration()
        old = jvm.org.apache.hadoop.fs.Path(f"{path}/version={batch_id - 2}")
        old.getFileSystem(conf).delete(old, True)

    return (
        counters.writeStream.outputMode("complete")
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(interval))
        .start()
    )


def read_counters(store: EventStore, path: str) -> DataFrame:
    """The newest version of the published counts."""
    versions = store.spark.read.parquet(path)
    newest = versions.selectExpr("max(version)").first()[0]
    return versions.where(versions["version"] == newest).drop("version")
