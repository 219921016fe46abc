"""States of a folder, as numbered JSON files in it, reached by Hadoop's file system alone.

A new state is a new file, created only where there is none of its number; a reader takes the newest that was written to its
end. So whatever a writer that dies leaves behind, the state before its last change stays readable, and of two writers that
change the same state one is told to look again.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: States that are kept beside the newest.
KEPT = 8


class Journal:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def file(self, path: str):
        """(file system, path) of Hadoop's."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def names(self, path: str, ending: str) -> list[str]:
        """The files of a folder whose names end so, in order; none if there is no folder."""
        fs, at = self.file(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(ending)) if fs.exists(at) else []

    def _read(self, name: str) -> str:
        fs, at = self.file(f"{self.path}/{name}")
        stream = fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def newest(self) -> tuple[dict | None, int]:
        """The newest whole state, and the number for the next."""
        names = self.names(self.path, ".json")
        after = 1 + int(names[-1].partition(".")[0]) if names else 0
        for name in reversed(names):
            try:
                return json.loads(self._read(name)), after
            except ValueError:
                continue  # its writer died, or is still writing
        return None, after

    def write(self, number: int, state: dict) -> bool:
        """Writes a state; False if there is one of that number."""
        fs, path = self.file(f"{self.path}/{number:08d}.json")
        try:
            stream = fs.create(path, False)
        except Py4JJavaError:
            if not fs.exists(path):
                raise
            return False
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        for name in self.names(self.path, ".json")[: -KEPT - 1]:
            fs.delete(self.file(f"{self.path}/{name}")[1], False)
        return True
