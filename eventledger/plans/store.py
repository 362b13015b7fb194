"""The event store: a Parquet table of events, and a quarantine beside it."""

from __future__ import annotations

import hashlib
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import date, time, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventledger.functions.fields import event_day
from eventledger.operators import metrics, paging
from eventledger.operators.clustering import clustered
from eventledger.operators.filters import Moment, as_utc, filter_events, get_event_by_id
from eventledger.plans.commits import APPEND, ARCHIVE, MERGE, Change, CommitLog
from eventledger.plans.files import Files
from eventledger.plans.keys import KeyTable
from eventledger.schema import (
    COUNT_SCHEMA,
    DEFAULT_LIMIT,
    EVENT_COLUMNS,
    QUARANTINE_COLUMNS,
    QUARANTINE_SCHEMA,
    STORED_SCHEMA,
)
from eventledger.session import prepare
from eventledger.streaming.source import CommitSource

COMPACT_BYTES = 128 << 20  # size that a merged file should have
ARCHIVE_BYTES = 256 << 20  # live files that one move to the archive takes; a day is moved whole
FOLD_COUNTS = 64  # batches whose counts may lie beside the folded ones
# Columns looked up by exact value. Bloom filters let a scan skip the row groups that
# cannot hold the value, which is what an index did for a row store.
_LOOKUP_COLUMNS = ("id", "session_id", "correlation_id")
# Columns by which the files of a merged day are cut.
CLUSTERED = ("session_id", "event_type", "timestamp")
# Filters that the counts can answer.
_COUNTED = ("event_type", "source", "start_time", "end_time")


def _bloom_options() -> dict[str, str]:
    options = {"parquet.bloom.filter.adaptive.enabled": "true"}
    for name in _LOOKUP_COLUMNS:
        options[f"parquet.bloom.filter.enabled#{name}"] = "true"
    return options


def _files_of(rows: DataFrame) -> list[str]:
    """Names of the files that hold ``rows``, a selection by partition. (``inputFiles`` would
    name every file of the table.) Names only, of which the driver's listing has them all."""
    names = rows.select(F.col("_metadata.file_name").alias("name")).distinct()
    return sorted(row["name"] for row in names.collect())


def _files_by_day(rows: DataFrame) -> dict[str, list[str]]:
    """Names of the files that hold ``rows``, a selection by partition, by day folder."""
    names = rows.select("event_date", F.col("_metadata.file_name").alias("name")).distinct()
    found: dict[str, list[str]] = {}
    for row in sorted(names.collect()):
        found.setdefault(f"event_date={row['event_date']}", []).append(row["name"])
    return found


class EventStore:
    """Events partitioned by UTC day under ``<root>/events``, rejects under
    ``<root>/quarantine``; beside them the key (``keys``), the counts by day and label
    (``counts``) and the records of changes (``commits``, ``pending``).

    Changes are done one at a time and whole, see ``commits``: a second one waits for the
    first and gives up when that stays open.

    Reads go through a snapshot of the file listing that ``refresh`` renews; appends
    through this object renew it by themselves.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = prepare(spark)
        self.root = root.rstrip("/")
        self.events_path = f"{self.root}/events"
        self.quarantine_path = f"{self.root}/quarantine"
        self.archive_path = f"{self.root}/archive"
        self.staging_path = f"{self.root}/staging"
        self._snapshot: DataFrame | None = None
        self.files = Files(spark, self.root)
        self.commits = CommitLog(self.files)
        self.keys = KeyTable(spark, self.files)

    def init(self, table: str | None = None) -> EventStore:
        """Create the tables where they are absent; existing data stays as it is.

        With ``table`` the events are also registered in the session catalog, so that
        SQL can name them.
        """
        for schema, path, partitions in (
            (STORED_SCHEMA, self.events_path, ["event_date"]),
            (QUARANTINE_SCHEMA, self.quarantine_path, ["writer", "batch_id"]),
        ):
            empty = self.spark.createDataFrame([], schema)
            empty.write.mode("ignore").partitionBy(*partitions).parquet(path)
        for folder in ("pending", "commits", "counts"):
            self.files.make_folder(folder)
        if not self.files.names("keys"):
            self.keys.init()
            if self.files.names("events"):  # a store from before there was a key
                rows = self.events().withColumn("file", F.col("_metadata.file_name"))
                self.keys.add(rows)
                self._count(Change(0, APPEND), rows, self.quarantine())
        if table:
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in STORED_SCHEMA)
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
                f"PARTITIONED BY (event_date) LOCATION '{self.events_path}'"
            )
            self.spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
        return self

    def refresh(self) -> EventStore:
        self._snapshot = None
        return self

    def events(self) -> DataFrame:
        """All stored events, unfiltered."""
        if self._snapshot is None:
            found = self.spark.read.schema(STORED_SCHEMA).parquet(self.events_path)
            for day, names in self.commits.not_counting().items():  # mostly none
                other_day = F.col("event_date") != F.lit(day.removeprefix("event_date=")).cast("date")
                found = found.where(other_day | ~F.col("_metadata.file_name").isin(names))
            self._snapshot = found
        return self._snapshot

    def get_event(self, event_id: str) -> DataFrame:
        """The event with this id, or no row. The key names its file: one bucket of the key
        and that file are opened, whatever the store holds."""
        paths = [f"{self.events_path}/event_date={day}/{file}" for day, file in self.keys.find(event_id)]
        if not paths:
            return self.spark.createDataFrame([], STORED_SCHEMA)
        reader = self.spark.read.schema(STORED_SCHEMA).option("basePath", self.events_path)
        return get_event_by_id(reader.parquet(*paths), event_id)

    def counts(self) -> DataFrame:
        """Counts by day and label that all recorded changes add up to: (event_date,
        event_type, source, error_type, n). Stored events have no ``error_type``, rejects no
        day; archived events have been taken off."""
        upto, columns = self._folded(), COUNT_SCHEMA.fieldNames()[:-1]
        later = self.spark.read.schema(COUNT_SCHEMA).parquet(f"{self.root}/counts")
        found = later.where((F.col("seq") > upto) & (F.col("seq") <= self.commits.last())).select(columns)
        if upto >= 0:
            found = found.union(self.spark.read.schema(COUNT_SCHEMA).parquet(f"{self.root}/folded/upto={upto}").select(columns))
        return found

    def _folded(self) -> int:
        """The change up to which counts are folded, -1 for none."""
        return max((int(n.removeprefix("ready-")) for n in self.files.names("folded") if n.startswith("ready-")), default=-1)

    def total_count(self, **wanted: Moment | None) -> DataFrame:
        """The number of events that match, as one row.

        Types, sources and whole days come from the counts; only the days that a time bound
        cuts are scanned. Any other filter needs a scan.
        """
        if any(value for name, value in wanted.items() if name not in _COUNTED):
            return paging.total_count(self.events(), **wanted)
        counted = self.counts().where("error_type IS NULL")
        for name in ("event_type", "source"):
            if wanted.get(name):
                counted = counted.where(F.col(name) == wanted[name])
        cut = []
        for name, whole in (("start_time", time.min), ("end_time", time.max)):
            bound = as_utc(wanted[name]) if wanted.get(name) else None
            if bound:
                day = bound.date()
                if bound.time() != whole:
                    cut.append(day)
                    day += timedelta(days=1 if name == "start_time" else -1)
                counted = counted.where(F.col("event_date") >= F.lit(day) if name == "start_time" else F.col("event_date") <= F.lit(day))
        total = counted.select("n")
        if cut:
            edges = filter_events(self.events().where(F.col("event_date").isin(cut)), **wanted)
            total = total.union(edges.agg(F.count("*").alias("n")))
        return total.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"))

    def query_page(self, limit: int = DEFAULT_LIMIT, offset: int = 0, **wanted: Moment | None) -> DataFrame:
        """One page of the matching events, newest first.

        On a large store the counts say which of the newest days hold the page, when they know
        the filters: only these days are opened, and nothing is counted by a scan.
        """
        events = self.events()
        asked = {name for name, value in wanted.items() if value}
        if not asked <= set(_COUNTED) or not paging.is_large(events) or offset + limit > paging.TOP_K_ROWS:
            return paging.query_page(events, limit, offset, **wanted)
        paging.validate_page_args(limit, offset)
        found = filter_events(events, **wanted)
        oldest = self._oldest_day_of_page(offset + limit, **wanted)
        if oldest:
            found = found.where(F.col("event_date") >= F.lit(oldest))
        return paging.page(found, limit, offset, prune=False)

    def _oldest_day_of_page(self, rows: int, **wanted: Moment | None) -> date | None:
        """The newest day from which on ``rows`` matches are sure to be there; None for all days."""
        counted = self.counts().where("error_type IS NULL")
        for name in ("event_type", "source"):
            if wanted.get(name):
                counted = counted.where(F.col(name) == wanted[name])
        cut = {as_utc(wanted[name]).date() for name in ("start_time", "end_time") if wanted.get(name)}
        if wanted.get("end_time"):
            counted = counted.where(F.col("event_date") <= F.lit(max(cut)))
        days = counted.groupBy("event_date").agg(F.sum("n").alias("n")).where("n > 0").collect()  # a row a day
        there = 0
        for row in sorted(days, key=lambda r: r["event_date"], reverse=True):
            there += 0 if row["event_date"] in cut else row["n"]  # a day that a bound cuts may hold none
            if there >= rows:
                return row["event_date"]
        return None

    def fetch_page(self, limit: int = DEFAULT_LIMIT, offset: int = 0, **wanted: Moment | None) -> paging.Page:
        """A page's rows and the total of all matches, as one call; the two jobs run side by side."""
        with ThreadPoolExecutor(2) as pool:
            total = pool.submit(lambda: self.total_count(**wanted).first()["total"])
            rows = pool.submit(lambda: self.query_page(limit, offset, **wanted).collect())
            return paging.Page(rows.result(), total.result(), limit, offset)

    def page_info(self, limit: int = DEFAULT_LIMIT, offset: int = 0, **wanted: Moment | None) -> DataFrame:
        """``total, limit, offset, has_more`` of a page, as one row, from the counts where they say it."""
        return paging.info_of_total(self.total_count(**wanted), limit, offset)

    def received_total(self) -> DataFrame:
        """Messages that passed validation, by type and source; archived events are taken off."""
        return metrics.received_of_counts(self.counts())

    def stored_total(self) -> DataFrame:
        totals = self.counts().where("error_type IS NULL").groupBy("event_type").agg(F.sum("n").alias("total"))
        return totals.where("total > 0")

    def failed_total(self) -> DataFrame:
        failed = self.counts().where("error_type IS NOT NULL")
        return failed.groupBy("event_type", "error_type").agg(F.sum("n").alias("total"))

    def quarantine(self) -> DataFrame:
        return self.spark.read.schema(QUARANTINE_SCHEMA).parquet(self.quarantine_path)

    def archive(self) -> DataFrame:
        return self.spark.read.schema(STORED_SCHEMA).parquet(self.archive_path)

    def append_events(
        self,
        events: DataFrame,
        writer: str | None = None,
        batch_id: int = 0,
        change: Change | None = None,
        rejects: DataFrame | None = None,
    ) -> None:
        """Add rows that have the event columns, all of them or none.

        The rows are staged in files of their own, entered in the key and counted; then the
        files are moved in and the change is recorded. ``change`` is one that ``begin`` has
        reserved; without it the call reserves its own. ``rejects`` are counted with it.

        The rebalance gives every day its own files of the advisory size: large days are
        split, small ones share a task. Rows are sorted within files so that row-group
        statistics narrow session and time filters.
        """
        writer = writer or f"append-{uuid.uuid4().hex}"
        change = change or self.commits.begin(APPEND, writer, batch_id)
        try:
            stamped = events.selectExpr(*EVENT_COLUMNS, f"{event_day()} AS event_date").withColumns(
                {
                    "writer": F.lit(writer),
                    "batch_id": F.lit(batch_id).cast("bigint"),
                    "commit_seq": F.lit(change.seq).cast("bigint"),
                }
            )
            self._write_by_day(stamped, f"{self.root}/{change.stage}")
            rows = self._staged(change)
            change.rows = self._count(change, rows, rejects)
            self.keys.add(rows)
            self.commits.ready(change)
        except BaseException:
            self.commits.cancel(change)
            raise
        self._finish(change)

    def _staged(self, change: Change) -> DataFrame:
        """The rows of a change's new files, each with the file's name; notes the names in ``change``."""
        days = [n for n in self.files.names(change.stage) if n.startswith("event_date=")]
        names = self.files.many(lambda day: self.files.names(f"{change.stage}/{day}"), days)
        change.add = {day: found for day, found in zip(days, names) if found}
        paths = [f"{self.root}/{change.stage}/{day}" for day in change.add]
        base = f"{self.root}/{change.stage}"
        reader = self.spark.read.schema(STORED_SCHEMA).option("basePath", base)
        rows = reader.parquet(*paths) if paths else self.spark.createDataFrame([], STORED_SCHEMA)
        return rows.withColumn("file", F.col("_metadata.file_name") if paths else F.lit(""))

    def _count(self, change: Change, rows: DataFrame, rejects: DataFrame | None = None, sign: int = 1) -> int:
        """Write the counts of a change by day and label; returns its number of events."""
        stored = rows.groupBy("event_date", "event_type", "source").agg(F.count("*").alias("n"))
        counts = stored.selectExpr("event_date", "event_type", "source", "CAST(NULL AS STRING) AS error_type", f"n * {sign} AS n")
        if rejects is not None:
            failed = rejects.groupBy("event_type", "source", "error_type").agg(F.count("*").alias("n"))
            counts = counts.unionByName(failed.withColumn("event_date", F.lit(None).cast("date")))
        path = f"{self.root}/counts/seq={change.seq}"
        counts.select(COUNT_SCHEMA.fieldNames()[:-1]).coalesce(1).write.mode("overwrite").parquet(path)
        written = self.spark.read.schema(COUNT_SCHEMA).parquet(path).where("error_type IS NULL").agg(F.sum("n")).first()[0]
        return abs(written or 0)

    def _finish(self, change: Change) -> None:
        self.commits.finish(change)
        if change.named:
            self.record_batch(change.writer, change.batch_id, events="stored")
        self.refresh()

    def begin(self, kind: str, writer: str = "", batch_id: int = 0) -> Change:
        """Reserve the next change, after what a lost driver has made ready is finished."""
        for done in self.commits.roll_forward():
            if done.named:
                self.record_batch(done.writer, done.batch_id, events="stored")
        return self.commits.begin(kind, writer, batch_id)

    def write_quarantine(self, rejects: DataFrame, writer: str, batch_id: int) -> None:
        """Store a batch's rejects; writing the same batch again replaces them."""
        (
            rejects.select(*QUARANTINE_COLUMNS)
            .withColumn("writer", F.lit(writer))
            .withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("writer", "batch_id")
            .parquet(self.quarantine_path)
        )

    def stage(self, rows: DataFrame, name: str) -> DataFrame:
        """Write ``rows`` under the store and read them back: their lineage ends here."""
        path = f"{self.staging_path}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop_stage(self, name: str) -> None:
        self.files.delete(f"staging/{name}")

    def archive_before(self, cutoff: Moment) -> int:
        """Move events of days before ``cutoff`` to the archive; returns how many moved.

        A move takes days up to ``ARCHIVE_BYTES``, so that small days do not cost some jobs each
        and other changes to the store wait for no more than that.

        A run that is cut short can be repeated: rows already in the archive are not
        copied again, and live files go only once all their rows are there. Files that an
        ingest adds meanwhile are not touched.
        """
        self.spark.createDataFrame([], STORED_SCHEMA).write.mode("ignore").partitionBy(
            "event_date"
        ).parquet(self.archive_path)
        old = self.refresh().events().where(F.col("event_date") < F.lit(as_utc(cutoff).date()))
        days = sorted(row["event_date"] for row in old.select("event_date").distinct().collect())
        moved = sum(self._archive_days(old.where(F.col("event_date").isin(some)), some) for some in self._moves(days))
        self.refresh()
        return moved

    def _moves(self, days: list[date]) -> list[list[date]]:
        """``days`` in runs whose files stay within ``ARCHIVE_BYTES``, a day at least."""
        sizes = self.files.many(lambda day: sum(self.files.sizes(f"events/event_date={day}").values()), days)
        moves: list[list[date]] = []
        room = 0
        for day, size in zip(days, sizes):
            if not moves or size > room:
                moves.append([])
                room = ARCHIVE_BYTES
            moves[-1].append(day)
            room -= size
        return moves

    def _archive_days(self, live: DataFrame, days: list[date]) -> int:
        """Copy what the archive lacks of some days, compare, and let the days' files go."""

        def lacking() -> DataFrame:
            if not any(self.files.many(lambda day: self.files.names(f"archive/event_date={day}"), days)):
                return live
            # Whole rows are compared: an id may have come back with another payload.
            done = self.archive().where(F.col("event_date").isin(days)).alias("done")
            names = STORED_SCHEMA.fieldNames()
            same = F.col("live.id") == F.col("done.id")
            for name in names:
                same &= F.col(f"live.{name}").eqNullSafe(F.col(f"done.{name}"))
            return live.alias("live").join(done, same, "left_anti")

        change = self.begin(ARCHIVE)
        try:
            self._write_by_day(lacking(), self.archive_path)
            missing = lacking().count()
            if missing:
                raise RuntimeError(f"{missing} events did not reach the archive; live rows kept")
            change.remove = _files_by_day(live)
            change.rows = self._count(change, live, sign=-1)
            self.commits.ready(change)
        except BaseException:
            self.commits.cancel(change)
            raise
        self._finish(change)
        return change.rows

    def compact(self, before: Moment) -> int:
        """Merge the many small files of days before ``before``; returns how many went.

        The merged files of a day are staged and entered in the key, then they take the place
        of the old ones in one change: at no time does a reader that asks ``events`` see a
        row twice or not at all, wherever a run is cut short. ``tail`` goes by the record of
        each append, so it delivers nothing again. The key and the counts are tidied as well.
        """
        old = self.refresh().events().where(F.col("event_date") < F.lit(as_utc(before).date()))
        gone = 0
        for day in sorted(row["event_date"] for row in old.select("event_date").distinct().collect()):
            sizes = self.files.sizes(f"events/event_date={day}")
            if len(sizes) > 1 + sum(sizes.values()) // COMPACT_BYTES:
                gone += self._merge_day(day)
        self.keys.tidy()
        self._fold_counts()
        self.refresh()
        return gone

    def _merge_day(self, day: date) -> int:
        change = self.begin(MERGE)
        try:
            live = self.refresh().events().where(F.col("event_date") == F.lit(day))
            files = _files_of(live)
            sizes = self.files.sizes(f"events/event_date={day}")
            count = 1 + sum(sizes.get(name, 0) for name in files) // COMPACT_BYTES
            # One file needs no order of files; several are cut so that each filter finds few.
            self._write_by_day(clustered(live, CLUSTERED, count) if count > 1 else live, f"{self.root}/{change.stage}", ordered=count > 1)
            rows = self._staged(change)
            change.rows = rows.count()
            if change.rows != live.count():
                raise RuntimeError("rows changed while a day was merged")
            self.keys.add(rows)
            change.remove = {f"event_date={day}": files}
            self.commits.ready(change)
        except BaseException:
            self.commits.cancel(change)
            raise
        self._finish(change)
        return len(files)

    def _fold_counts(self) -> None:
        """Join the counts of recorded changes, of which each batch adds a small file.

        The folded counts hold once they are marked; files that they stand for go after that.
        """
        last, before = self.commits.last(), self._folded()
        folders = {int(n.removeprefix("seq=")): n for n in self.files.names("counts")}
        if sum(before < seq <= last for seq in folders) > FOLD_COUNTS:
            labels = ["event_date", "event_type", "source", "error_type"]
            total = self.counts().groupBy(*labels).agg(F.sum("n").alias("n")).where("n <> 0")
            total.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/folded/upto={last}")
            self.files.create(f"folded/ready-{last}", "")
            before = last
        self.files.many(self.files.delete, [f"counts/{n}" for seq, n in folders.items() if seq <= before])

    def batch_state(self, writer: str, batch_id: int) -> dict[str, str]:
        """What is recorded of a batch: ``digest`` of its input, ``rejects`` and ``events`` once written."""
        names = self.files.names(self._batch_path(writer, batch_id))
        return dict(name.split("=", 1) for name in names if "=" in name)

    def record_batch(self, writer: str, batch_id: int, **state: str) -> None:
        for name, value in state.items():
            self.files.make_folder(f"{self._batch_path(writer, batch_id)}/{name}={value}")

    def _batch_path(self, writer: str, batch_id: int) -> str:
        return f"batches/{hashlib.md5(writer.encode()).hexdigest()}/{batch_id}"

    def tail(self, **wanted: Moment | None) -> DataFrame:
        """A stream of the stored events: what is there first, then what arrives.

        It goes by the records of appends, not by files, so each event comes once, whether its
        file has been merged since or its batch was run again.
        """
        self.spark.dataSource.register(CommitSource)
        reader = self.spark.readStream.format(CommitSource.name()).option("path", self.root)
        return filter_events(reader.load(), **wanted)

    def quarantine_tail(self) -> DataFrame:
        return self.spark.readStream.schema(QUARANTINE_SCHEMA).parquet(self.quarantine_path)

    def _write_by_day(self, rows: DataFrame, path: str, ordered: bool = False) -> None:
        if not ordered:
            rows = rows.hint("rebalance", "event_date").sortWithinPartitions("event_date", "session_id", "timestamp")
        (
            rows.write.options(**_bloom_options())
            .mode("append")
            .partitionBy("event_date")
            .parquet(path)
        )
