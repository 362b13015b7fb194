"""A streaming source over the recorded appends of a store.

Its offset is the number of the last change delivered. A record names the files of an append;
where they have been merged since, the append's rows are picked from the files of their
day by ``commit_seq``. So what is delivered depends on the appends alone, each once.

The files are read by Arrow in the tasks, from local paths and the object stores and
file systems that Arrow knows. Nothing of an append passes through the driver but names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from eventledger.plans.commits import APPEND, last_recorded, record_name
from eventledger.schema import STORED_SCHEMA

_BATCH_ROWS = 10_000


@dataclass
class AppendPart(InputPartition):
    """Files of one day; ``seq`` picks the rows where the files hold those of other appends too."""

    day: str
    files: list[str]
    seq: int | None = None


class _Tree:
    """A store's folder as Arrow sees it."""

    def __init__(self, root: str):
        from pyarrow import fs

        if root.startswith("file:"):
            root = "/" + root.removeprefix("file:").lstrip("/")
        if "://" in root:
            self.fs, self.root = fs.FileSystem.from_uri(root)
        else:
            self.fs, self.root = fs.LocalFileSystem(), root

    def _info(self, name: str):
        return self.fs.get_file_info(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self._info(name).size is not None

    def names(self, folder: str) -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and f.base_name[0] not in "._")

    def json(self, name: str) -> dict:
        with self.fs.open_input_stream(f"{self.root}/{name}") as file:
            return json.loads(file.read())


class AppendReader(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root
        self._last = 0

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def latestOffset(self) -> dict:
        tree = _Tree(self.root)
        self._last = last_recorded(lambda seq: tree.exists(record_name(seq)), self._last)
        return {"seq": self._last}

    def commit(self, end: dict) -> None:
        """Nothing to do: records stay."""

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        tree = _Tree(self.root)
        parts: list[InputPartition] = []
        listed: dict[str, set[str]] = {}
        for seq in range(start["seq"] + 1, end["seq"] + 1):
            change = tree.json(record_name(seq))
            if change["kind"] != APPEND:
                continue
            for day, files in change["add"].items():
                if day not in listed:
                    listed[day] = set(tree.names(f"events/{day}"))
                if listed[day].issuperset(files):
                    parts += [AppendPart(day, [f]) for f in files]
                else:
                    others = listed[day] - set(files) - self._not_counting(tree, day)
                    parts.append(AppendPart(day, sorted(others), seq))
        return parts

    def _not_counting(self, tree: _Tree, day: str) -> set[str]:
        out: set[str] = set()
        for name in tree.names("pending"):
            if name.endswith(".ready"):
                change = tree.json(f"pending/{name}")
                out.update(change["remove" if tree.exists(record_name(change["seq"])) else "add"].get(day, []))
        return out

    def read(self, partition: AppendPart) -> Iterator:
        import datetime

        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        tree = _Tree(self.root)
        schema = to_arrow_schema(STORED_SCHEMA)
        day = datetime.date.fromisoformat(partition.day.removeprefix("event_date="))
        for file in partition.files:
            found = ds.dataset(f"{tree.root}/events/{partition.day}/{file}", filesystem=tree.fs, format="parquet")
            only = None if partition.seq is None else pc.field("commit_seq") == partition.seq
            for batch in found.to_batches(filter=only, batch_size=_BATCH_ROWS):
                columns = [
                    pa.array([day] * batch.num_rows, f.type) if f.name == "event_date" else _as(batch, f) for f in schema
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _as(batch, field):
    """A column in the type Spark expects; files from before it existed have none."""
    import pyarrow as pa

    if field.name not in batch.schema.names:
        return pa.nulls(batch.num_rows, field.type)
    return batch.column(field.name).cast(field.type, safe=False)


class CommitSource(DataSource):
    """Option: ``path``, the store's folder."""

    @classmethod
    def name(cls) -> str:
        return "eventledger_appends"

    def schema(self) -> StructType:
        return STORED_SCHEMA

    def streamReader(self, schema: StructType) -> AppendReader:
        return AppendReader(self.options["path"].rstrip("/"))
