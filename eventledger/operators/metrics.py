"""Counters, histograms and gauges as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventledger.operators.envelopes import received
from eventledger.schema import STORAGE_LATENCY_BUCKETS


def events_received_total(rows: DataFrame) -> DataFrame:
    """Messages that passed validation, by type and source. ``rows`` is the output of
    ``normalize_envelope``: later failures and duplicates count as received."""
    return received(rows).groupBy("event_type", "source").agg(F.count("*").alias("total"))


def received_of_store(events: DataFrame, quarantine: DataFrame) -> DataFrame:
    """The same counts from what the ingest has kept, without decoding anything again."""
    kept = events.select("event_type", "source", F.lit(None).cast("string").alias("error_type"))
    return events_received_total(kept.union(quarantine.select("event_type", "source", "error_type")))


def received_of_counts(counts: DataFrame) -> DataFrame:
    """The same from a store's counts, of which each row stands for ``n`` messages."""
    totals = received(counts).groupBy("event_type", "source").agg(F.sum("n").alias("total"))
    return totals.where("total > 0")


def events_stored_total(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("total"))


def events_failed_total(quarantine: DataFrame) -> DataFrame:
    return quarantine.groupBy("event_type", "error_type").agg(F.count("*").alias("total"))


def histogram(
    rows: DataFrame, seconds: str, bounds: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Cumulative buckets of the SQL expression ``seconds``, in one pass.

    One row per bound and one for ``+Inf``: ``le, bucket_count`` with the overall
    ``observed_sum`` and ``observed_count`` beside them. The sum runs over decimals, so
    it does not depend on the order in which partitions are merged.
    """
    counts = ", ".join(f"count_if(_s <= {float(bound)}D)" for bound in bounds)
    folded = (
        rows.selectExpr(*by, f"{seconds} AS _s")
        .where("_s IS NOT NULL")
        .groupBy(*by)
        .agg(
            F.expr(f"array({counts}, count(*)) AS _counts"),
            F.expr("CAST(coalesce(sum(CAST(_s AS DECIMAL(28, 9))), 0) AS DOUBLE) AS observed_sum"),
            F.expr("count(*) AS observed_count"),
        )
    )
    labels = ", ".join(f"'{label}'" for label in [*map(float, bounds), "+Inf"])
    return folded.selectExpr(
        *by,
        f"inline(transform(array({labels}), "
        "(label, i) -> named_struct('le', label, 'bucket_count', _counts[i])))",
        "observed_sum",
        "observed_count",
    )


def storage_latency_histogram(
    events: DataFrame, bounds: Sequence[float] = STORAGE_LATENCY_BUCKETS
) -> DataFrame:
    return histogram(events, "storage_latency_ms / 1000", bounds)


def latest_storage_latency(events: DataFrame) -> DataFrame:
    """The last observed latency in milliseconds."""
    return events.agg(
        F.expr("max_by(storage_latency_ms, struct(stored_at, id)) AS storage_latency_ms")
    )
