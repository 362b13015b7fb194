"""The key of a store: which ids it holds, in buckets, and in which file each event lies.

``keys/b<N>/bucket=<i>`` holds the ids with ``crc32(id) % N = i``, sorted within each file.
Whoever asks for ids opens the buckets of these ids and nothing else. A row of the key
counts only while the file it names is live, so files that go need no change of the key: an
archived id is free again, and a merge adds rows for its new files before the old ones go.

``tidy`` joins the files of buckets that many batches have added to, drops rows whose
file is gone, and doubles the number of buckets as ids come, so that a bucket stays
about the same size whatever the store holds. Repeated rows do no harm, so all of it may be
cut short and repeated.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventledger.plans.files import Files

BUCKETS = 16  # of a new store
BUCKET_IDS = 1_000_000  # ids in a bucket from which the buckets are doubled
MERGE_FILES = 8  # files of a bucket from which they are joined
LISTED_BUCKETS = 1_000  # beyond so many, the whole key is listed by Spark

KEY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("file", T.StringType()),
        T.StructField("writer", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)


class KeyTable:
    def __init__(self, spark: SparkSession, files: Files, events: str = "events"):
        self.spark = spark
        self.files = files
        self.events = events

    def init(self, buckets: int = BUCKETS) -> None:
        if not self.files.names("keys"):
            self.files.make_folder(f"keys/b{buckets}")
            self.files.create(f"keys/ready-{buckets}", "")

    @property
    def buckets(self) -> int:
        """Number of buckets of the newest whole generation."""
        return max(int(n.removeprefix("ready-")) for n in self.files.names("keys") if n.startswith("ready-"))

    def bucket_of(self, buckets: int, column: str = "id") -> str:
        """SQL for the bucket of an id."""
        return f"CAST(crc32(CAST({column} AS BINARY)) % {buckets} AS INT)"

    def all(self) -> DataFrame:
        return self.spark.read.schema(KEY_SCHEMA).parquet(f"{self.files.root}/keys/b{self.buckets}")

    def of_buckets(self, wanted: Sequence[int], buckets: int) -> DataFrame:
        """Rows of these buckets only; the others are not even listed."""
        base = f"{self.files.root}/keys/b{buckets}"
        reader = self.spark.read.schema(KEY_SCHEMA).option("basePath", base)
        if len(wanted) > LISTED_BUCKETS:
            return reader.parquet(base).where(F.col("bucket").isin([int(b) for b in wanted]))
        there = self.files.many(lambda b: self.files.exists(f"keys/b{buckets}/bucket={b}"), wanted)
        paths = [f"{base}/bucket={b}" for b, found in zip(wanted, there) if found]
        # The optimizer sees that a limit of 0 is empty: whatever is joined with it is not run.
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], KEY_SCHEMA).limit(0)

    def add(self, rows: DataFrame) -> None:
        """Add rows (id, event_date, file, writer, batch_id)."""
        self._write(rows, self.buckets)

    def _write(self, rows: DataFrame, buckets: int, mode: str = "append") -> None:
        (
            rows.selectExpr("id", "event_date", "file", "writer", "batch_id", f"{self.bucket_of(buckets)} AS bucket")
            .hint("rebalance", "bucket")
            .sortWithinPartitions("bucket", "id")
            .write.mode(mode)
            .partitionBy("bucket")
            .parquet(f"{self.files.root}/keys/b{buckets}")
        )

    def held(self, ids: DataFrame, wanted: Sequence[int], buckets: int) -> DataFrame:
        """Key rows of ``ids``, a table (id, bucket) with ids that lie in the buckets ``wanted``;
        rows whose file is gone are among them, see ``live``."""
        return self.of_buckets(wanted, buckets).join(ids, ["bucket", "id"], "left_semi")

    def live(self, rows: DataFrame) -> DataFrame:
        """Key rows whose file is still there. Only the files that ``rows`` name are looked up."""
        named = rows.select("event_date", "file").distinct().collect()  # at most the files of the store
        dead = self._dead([(str(r.event_date), r.file) for r in named])
        if not dead:
            return rows
        gone = self.spark.createDataFrame(dead, "_day string, _file string")
        match = (F.col("event_date").cast("string") == F.col("_day")) & (F.col("file") == F.col("_file"))
        return rows.join(gone, match, "left_anti")

    def _dead(self, named: list[tuple[str, str]]) -> list[tuple[str, str]]:
        days = sorted({day for day, _ in named})
        there = dict(zip(days, self.files.many(lambda d: set(self.files.names(f"{self.events}/event_date={d}")), days)))
        return [(day, file) for day, file in named if file not in there[day]]

    def find(self, event_id: str) -> list[tuple[str, str]]:
        """(day, file) of the event with this id: its bucket is opened, nothing else."""
        buckets = self.buckets
        bucket = zlib.crc32(event_id.encode()) % buckets
        found = self.of_buckets([bucket], buckets).where(F.col("id") == event_id).select("event_date", "file").distinct().collect()
        named = [(str(r.event_date), r.file) for r in found]
        dead = set(self._dead(named))
        return [n for n in named if n not in dead]

    def files_of(self, event_id: str) -> dict[str, int]:
        """Key files, and their bytes, that a lookup of this id opens."""
        buckets = self.buckets
        return self.files.sizes(f"keys/b{buckets}/bucket={zlib.crc32(event_id.encode()) % buckets}")

    def tidy(self, merge_files: int = MERGE_FILES, bucket_ids: int = BUCKET_IDS) -> None:
        """Join small files, drop rows whose file is gone, double the buckets when they are full."""
        self._drop_old_generations()
        buckets, rows = self.buckets, self.all().count()  # from the footers
        wanted = buckets
        while rows > wanted * bucket_ids:
            wanted *= 2
        if wanted > buckets:
            self._write(self.live(self.all()).distinct(), wanted, "overwrite")
            self.files.create(f"keys/ready-{wanted}", "")
            self._drop_old_generations()
            return
        folders = self.files.names(f"keys/b{buckets}")
        held = dict(zip(folders, self.files.many(lambda n: self.files.names(f"keys/b{buckets}/{n}"), folders)))
        crowded = {name: old for name, old in held.items() if len(old) > merge_files}
        if crowded:
            numbers = [int(name.removeprefix("bucket=")) for name in crowded]
            self._write(self.live(self.of_buckets(numbers, buckets)).distinct(), buckets)
            gone = [f"keys/b{buckets}/{name}/{n}" for name, old in crowded.items() for n in old]
            self.files.many(self.files.delete, gone)

    def _drop_old_generations(self) -> None:
        newest = self.buckets
        for name in self.files.names("keys"):
            count = int(name.removeprefix("ready-").removeprefix("b"))
            if count != newest:
                self.files.delete(f"keys/{name}")
