"""Tables by name: registered Parquet data, DataFrames, and the session's own append-only tables.

With a folder, own tables are Parquet folders in it, and a journal in it lists them, so a later session on the same folder
finds them. Tables' folders have names that never come again: whatever a session that dies leaves behind, the list before its
last change stays readable, and no table's rows are written over. Without a folder own tables live in the session. Files are
reached by Hadoop's file system alone: the folder may be in any store that Spark can write to.
"""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cairn.errors import BindError, EngineError
from cairn.sources.journal import Journal

#: Files that a table's INSERTs may leave before they are written together.
FILES = 64
#: Footers that an estimate of a table reads at most.
FOOTERS = 16
#: Footers are read once for each state of a path: {session: {path: (when and how it was last changed, schema)}}.
SCHEMAS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


@dataclass
class Entry:
    id: int
    schema: T.StructType
    #: Where the data is; None: in `df`, or in `rows`.
    path: str | None = None
    df: DataFrame | None = None
    #: Whether the session may insert into it.
    own: bool = False
    #: What was inserted into a table without a folder, a batch for each statement.
    rows: list[pa.RecordBatch] = field(default_factory=list)

    def json(self) -> dict:
        return {"id": self.id, "folder": self.path.rpartition("/")[2], "schema": self.schema.jsonValue()}


class Catalog:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path.rstrip("/") if path else None
        self.journal = Journal(spark, f"{self.path}/catalog")
        self.entries: dict[str, Entry] = {}
        self._refresh()

    # the list of own tables

    def _refresh(self) -> int:
        """Takes own tables from the newest list; the number for the next."""
        if not self.path:
            return 0
        found, number = self.journal.newest()
        if found is not None:
            held = {n: e for n, e in self.entries.items() if not e.own}
            self.entries = held | {n: Entry(e["id"], T.StructType.fromJson(e["schema"]), f"{self.path}/{e['folder']}", own=True) for n, e in found.items() if n not in held}
        return number

    def _commit(self, change: Callable[[], object], tries: int = 20) -> None:
        """Applies `change` to the newest list and writes the result as the next, again if another session was first."""
        for _ in range(tries):
            number = self._refresh()
            change()
            if self.journal.write(number, {n: e.json() for n, e in self.entries.items() if e.own}):
                return
        raise EngineError(f"other sessions keep changing {self.path}")

    # tables

    def _next_id(self) -> int:
        return 1 + max((e.id for e in self.entries.values()), default=-1)

    def _add(self, name: str, schema: T.StructType, **more) -> Entry:
        if name in self.entries:
            raise BindError(f"table {name!r} exists")
        entry = self.entries[name] = Entry(self._next_id(), schema, **more)
        return entry

    def register(self, name: str, df: DataFrame) -> None:
        """A DataFrame as a table that can be read."""
        self._add(name, df.schema, df=df)

    def register_parquet(self, name: str, path: str) -> None:
        """Parquet data as a table that can be read. Footers are read only where the path has changed since this session read them."""
        fs, at = self.journal.file(path)
        known, state = SCHEMAS.setdefault(self.spark, {}), None
        if fs.exists(at):
            status = fs.getFileStatus(at)
            state = (status.getModificationTime(), status.getLen())
        if state is None or known.get(path, (None,))[0] != state:
            known[path] = (state, self.spark.read.parquet(path).schema)
        schema = known[path][1]
        self._add(name, schema, path=path, df=self.spark.read.schema(schema).parquet(path))

    def create(self, name: str, schema: T.StructType) -> int:
        """A new, empty table of the session's own; its id."""
        if not self.path:
            return self._add(name, schema, own=True).id
        if name in self.entries:
            raise BindError(f"table {name!r} exists")
        path = f"{self.path}/table-{uuid.uuid4().hex}"
        self.spark.createDataFrame([], schema).write.parquet(path)
        self._commit(lambda: self._add(name, schema, path=path, own=True))
        return self.entries[name].id

    def insert(self, name: str, rows: list[tuple]) -> int:
        """Appends rows that fit the schema. One statement's rows come from the driver, so one file takes them; a table of
        many files is written anew in few."""
        entry = self.entries[name]
        if not entry.own:
            raise BindError(f"table {name!r} can only be read")
        kinds = to_arrow_schema(entry.schema)
        batch = pa.record_batch([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], schema=kinds)
        if not entry.path:
            entry.rows.append(batch)
            entry.df = None
            return len(rows)
        self._frame(entry, [batch]).coalesce(1).write.mode("append").parquet(entry.path)
        if len(self.journal.names(entry.path, ".parquet")) > FILES:
            self._compact(name)
        return len(rows)

    def _compact(self, name: str) -> None:
        """The rows of a table in a new folder, in files of the size that scans are cut to. The old folder is left, as results
        that were not computed yet may still read it. One session at a time may write to a folder's tables."""
        old = self.entries[name]
        fs, at = self.journal.file(old.path)
        size = int(self.spark._jsc.hadoopConfiguration().getLong("parquet.block.size", 128 << 20))
        files = max(1, -(-fs.getContentSummary(at).getLength() // size))
        path = f"{self.path}/table-{uuid.uuid4().hex}"
        self.table(name).coalesce(files).write.parquet(path)

        def change() -> None:
            self.entries[name].path = path

        self._commit(change)

    def _frame(self, entry: Entry, batches: list[pa.RecordBatch]) -> DataFrame:
        return self.spark.createDataFrame(pa.Table.from_batches(batches, to_arrow_schema(entry.schema)), entry.schema)

    def table(self, name: str) -> DataFrame | None:
        entry = self.entries.get(name)
        if entry is None:
            return None
        if entry.df is None and not entry.path:
            entry.df = self._frame(entry, entry.rows)
        return entry.df if entry.df is not None else self.spark.read.schema(entry.schema).parquet(entry.path)

    def extent(self, name: str, column: str) -> tuple[float, float] | None:
        """About how many rows registered Parquet data has, and how many values an integer column can have, by the statistics of
        its first files' footers; None where these don't say. It serves plans only, as files may change."""
        entry = self.entries[name]
        if not entry.path or entry.own:
            return None
        fs, at = self.journal.file(entry.path)
        if not fs.exists(at):
            return None
        files = [s for s in fs.listStatus(at) if s.isFile() and s.getPath().getName()[0] not in "_."]
        parquet, conf = self.spark._jvm.org.apache.parquet.hadoop, self.spark._jsc.hadoopConfiguration()
        rows, ends = 0, []
        for f in files[:FOOTERS]:
            reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromStatus(f, conf))
            try:
                for block in reader.getFooter().getBlocks():
                    rows += block.getRowCount()
                    found = [c.getStatistics() for c in block.getColumns() if c.getPath().toDotString() == column]
                    ends += [(s.genericGetMin(), s.genericGetMax()) for s in found if s is not None and s.hasNonNullValue()]
            finally:
                reader.close()
        if not rows or not ends or not all(isinstance(x, int) for e in ends for x in e):
            return None
        share = sum(f.getLen() for f in files[:FOOTERS]) / sum(f.getLen() for f in files)
        return rows / share, max(e[1] for e in ends) - min(e[0] for e in ends) + 1

    def listed(self) -> list[tuple[str, int, int]]:
        """(name, columns, rows) by name."""
        return [(n, len(e.schema), self.table(n).count()) for n, e in sorted(self.entries.items())]

    def described(self, name: str) -> list[tuple[str, T.DataType, int]] | None:
        entry = self.entries.get(name)
        return None if entry is None else [(f.name, f.dataType, i) for i, f in enumerate(entry.schema)]
