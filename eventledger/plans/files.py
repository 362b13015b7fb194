"""Small files and folders of a store, on any file system that Spark reaches."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

_THREADS = 16


class Files:
    """Names are relative to ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root
        self._jvm = spark._jvm
        self._fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        """Visible entries of a folder; none when it is absent."""
        if not self.exists(folder):
            return []
        found = [str(f.getPath().getName()) for f in self._fs.listStatus(self.path(folder))]
        return sorted(n for n in found if n[0] not in "._")

    def sizes(self, folder: str) -> dict[str, int]:
        """Bytes of the files of a folder, by name."""
        if not self.exists(folder):
            return {}
        found = {str(f.getPath().getName()): f.getLen() for f in self._fs.listStatus(self.path(folder)) if f.isFile()}
        return {n: size for n, size in found.items() if n[0] not in "._"}

    def many(self, work, names: Iterable[str]) -> list:
        """``work`` on each name, several at a time."""
        with ThreadPoolExecutor(_THREADS) as pool:
            return list(pool.map(work, names))

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Make a file unless it is there; of several callers one gets True."""
        try:
            stream = self._fs.create(self.path(name), False)
        except Exception:
            if self.exists(name):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def put(self, name: str, text: str) -> None:
        """Make a file that is seen whole or not at all."""
        part = f"{name}.part"
        self.delete(part)
        self.create(part, text)
        self.move(part, name)

    def move(self, name: str, to: str) -> None:
        if not self._fs.rename(self.path(name), self.path(to)):
            raise RuntimeError(f"{name} could not be moved to {to}")

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def make_folder(self, name: str) -> None:
        self._fs.mkdirs(self.path(name))
