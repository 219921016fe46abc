"""Substring deduplication over a log-structured index of fingerprints.

A window is `WINDOW` consecutive words. Its fingerprint is the smallest hash among its runs of `GRAM` words, so equal windows
have equal fingerprints, and neighbouring windows mostly share theirs: about one fingerprint for five words is kept.

The index is a folder with a journal, so a later session goes on where one ended, and a batch that was not added to its end
leaves no trace. Each batch of documents is written once, as segments of a few megabytes (compressed Arrow rows; a file for
each task, which is a part), and as one immutable run: for each bucket of the hash space and each segment, its different
fingerprints in order. Runs lie bucketed in the store, so a batch is merged with them where they are. What comes back to a
segment is one bit for each fingerprint: for the batch's own whether it is met elsewhere, for earlier ones whether the batch
has it. Only windows with such a fingerprint are then verified, by 96 bits of hash over their words; of earlier segments
only the files that have one are read. Each segment sends its different windows once, with the smallest doc_id that has
them, and again gets a bit for each: whether a smaller one is elsewhere. A passage that a third of all documents share is
thus one entry for each segment, never a group of documents; and texts stay where they were written, as bits come to them.
As many runs of one level as `FAN` are merged into one of the next.
"""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from cairn.llm.common import batches, delete, documents, kept, scratch, slices
from cairn.sources.journal import Journal

WINDOW, GRAM, FAN = 13, 5, 4
SEGMENT_BYTES = 3 << 20
#: Bytes of fingerprints in a bucket, about, for which an index is laid out; runs are dealt anew when there are four times as many.
BUCKET_BYTES = 8 << 20
#: Batches that dedup() puts a table into an index in.
BATCHES = 3
LAST = np.iinfo(np.int64).max  # stands for a null doc_id
SEGMENT = "part long, segment long, n_bytes long, rows binary"
RUN = "bucket int, part long, segment long, hashes binary, several binary"
WINDOWS = "bucket int, part long, segment long, w0 binary, w1 binary, least binary"
BITS = "part long, segment long, bucket int, bits binary"
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def rolling(words: np.ndarray, size: int, multiplier: np.uint64) -> np.ndarray:
    """A hash of each run of `size` words, from the words' hashes: a polynomial modulo 2 ** 64 (Horner's rule), then mixed."""
    n = len(words) - size + 1
    out = words[:n].copy()
    for j in range(1, size):
        out *= multiplier
        out += words[j : j + n]
    return mixed(out)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each `size` values in a row, by doubling."""
    have = 1
    while have * 2 <= size:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (size - have)], values[size - have :]) if size > have else values


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


class Segment:
    """The words of some documents by their hashes, their windows, and the windows' fingerprints. Words themselves are made for one
    document at a time, as they take several times the text's bytes."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        self.texts = texts
        hashes = [b"".join(map(xxh3_128_digest, words_of(t))) for t in texts]
        self.ends = np.cumsum([0] + [len(h) // 16 for h in hashes])
        self.ids = np.array([LAST if i is None else i for i in ids], np.int64)
        lanes = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
        self.lanes = [np.ascontiguousarray(lanes[:, 0]), np.ascontiguousarray(lanes[:, 1])]
        n = max(0, len(lanes) - WINDOW + 1)
        owner = np.repeat(np.arange(len(texts)), np.diff(self.ends))
        self.starts = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :]) if n else np.zeros(0, np.int64)
        self.owner = owner[self.starts] if n else np.zeros(0, np.int64)
        self.prints = sliding_min(rolling(self.lanes[0], GRAM, MULTIPLIERS[0]), WINDOW - GRAM + 1)[self.starts] if n else np.zeros(0, np.uint64)

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """The different fingerprints in order, and whether several documents of the segment have each."""
        if not len(self.prints):
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        new = np.flatnonzero(np.concatenate([[True], (self.prints[1:] != self.prints[:-1]) | (self.owner[1:] != self.owner[:-1])]))
        prints, owner = self.prints[new], self.owner[new]
        order = np.lexsort((owner, prints))
        prints, owner = prints[order], owner[order]
        first = np.concatenate([[True], prints[1:] != prints[:-1]])
        changes = np.concatenate([[False], (owner[1:] != owner[:-1]) & ~first[1:]])
        return prints[first], np.bitwise_or.reduceat(changes, np.flatnonzero(first))

    def candidates(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows whose fingerprint is shared (bits in the order of fingerprints()): start, document's place, and the two parts of the verifying hash."""
        known = self.fingerprints()[0]
        at = np.flatnonzero(shared[np.searchsorted(known, self.prints)]) if len(known) else np.zeros(0, np.int64)
        starts, w0, w1 = self.starts[at], np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for j in range(WINDOW):
            w0 = w0 * MULTIPLIERS[0] + self.lanes[0][starts + j]
            w1 = w1 * MULTIPLIERS[1] + self.lanes[1][starts + j]
        return starts, self.owner[at], mixed(w0), (mixed(w1) >> np.uint64(32)).astype(np.uint32)


class Windows:
    """A segment's candidate windows by their hash: the different ones in order, and the smallest doc_id with each."""

    def __init__(self, segment: Segment, shared: np.ndarray):
        self.starts, owner, w0, w1 = segment.candidates(shared)
        ids = segment.ids[owner]
        order = np.lexsort((ids, w1, w0))
        self.starts, self.ids, w0, w1 = self.starts[order], ids[order], w0[order], w1[order]
        first = np.ones(len(order), bool)
        first[1:] = (w0[1:] != w0[:-1]) | (w1[1:] != w1[:-1])
        self.w0, self.w1, self.least, self.group = w0[first], w1[first], self.ids[first], np.cumsum(first) - 1

    def repeated(self, elsewhere: np.ndarray) -> np.ndarray:
        """Starts of the windows that a smaller doc_id has too; elsewhere: whether another segment's is smaller than all here."""
        return self.starts[elsewhere[self.group] | (self.ids > self.least[self.group])] if len(self.starts) else self.starts


def bucketed(hashes: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """(bucket, where its hashes are) of ordered hashes; a bucket is a range of hashes, `buckets` a power of two."""
    if not len(hashes):
        return []
    top = hashes >> np.uint64(64 - (buckets.bit_length() - 1)) if buckets > 1 else np.zeros(len(hashes), np.uint64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(top)) + 1, [len(top)]])
    return [(int(top[a]), slice(int(a), int(b))) for a, b in zip(edges, edges[1:], strict=False)]


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rows)).read_all()


def of(rows: bytes) -> Segment:
    table = unpacked(rows)
    return Segment(table.column("doc_id").to_pylist(), table.column("text").to_pylist())


def in_order(parts: list[dict] | None, segment_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bits that came back for a segment, bucket by bucket, in the order of its hashes."""
    back = {p["bucket"]: p["bits"] for p in parts or []}
    out = np.zeros(len(segment_hashes), bool)
    for bucket, where in bucketed(segment_hashes, buckets):
        if bucket in back:
            out[where] = unbits(back[bucket], where.stop - where.start)
    return out


def answer(bucket: int, parts: list[int], segments: list[int], ends: np.ndarray, flags: np.ndarray) -> pa.Table:
    """A row of bits for each segment that has one set."""
    rows = [(p, s, bucket, bits(flags[a:b])) for p, s, a, b in zip(parts, segments, ends, ends[1:], strict=False) if flags[a:b].any()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([],) * 4, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["part", "segment", "bucket", "bits"])


def merge(first: int):
    """Over the rows of a bucket: whether each fingerprint of the batch, whose parts are numbered from `first`, is in several
    documents, and whether each earlier one is in the batch."""

    def of_bucket(table: pa.Table) -> pa.Table:
        parts, hashes = table.column("part").to_pylist(), [np.frombuffer(x, "<u8") for x in table.column("hashes").to_pylist()]
        sizes = [len(h) for h in hashes]
        several = np.concatenate([unbits(x, n) for x, n in zip(table.column("several").to_pylist(), sizes, strict=True)])
        new = np.repeat(np.array(parts) >= first, sizes)
        everything = np.concatenate(hashes)
        order = np.argsort(everything, kind="stable")  # merges what is in order already
        ordered, new, several = everything[order], new[order], several[order]
        start = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        group, at = np.cumsum(start) - 1, np.flatnonzero(start)
        of_batch = np.add.reduceat(new, at, dtype=np.int64)
        met = np.diff(np.append(at, len(ordered))) > 1
        flags = np.empty(len(order), bool)
        flags[order] = np.where(new, several | met[group], (of_batch > 0)[group])
        return answer(table.column("bucket")[0].as_py(), parts, table.column("segment").to_pylist(), np.cumsum([0, *sizes]), flags)

    return of_bucket


def verify(first: int):
    """Over the candidate windows of a bucket: for each segment of the batch, whether another segment has the window in a
    document with a smaller doc_id than this one's smallest."""

    def of_bucket(table: pa.Table) -> pa.Table:
        parts = table.column("part").to_pylist()
        w0 = [np.frombuffer(x, "<u8") for x in table.column("w0").to_pylist()]
        sizes = [len(x) for x in w0]
        h0, h1 = np.concatenate(w0), np.concatenate([np.frombuffer(x, "<u4") for x in table.column("w1").to_pylist()])
        least = np.concatenate([widen(x, n) for x, n in zip(table.column("least").to_pylist(), sizes, strict=True)])
        order = np.lexsort((least, h1, h0))
        a, b, own = h0[order], h1[order], least[order]
        start = np.ones(len(order), bool)
        start[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        flags = np.empty(len(order), bool)
        flags[order] = own[np.flatnonzero(start)][np.cumsum(start) - 1] < own
        flags &= np.repeat(np.array(parts) >= first, sizes)
        return answer(table.column("bucket")[0].as_py(), parts, table.column("segment").to_pylist(), np.cumsum([0, *sizes]), flags)

    return of_bucket


def power_of_two(n: int) -> int:
    """The smallest that is not below n."""
    return 1 << max(0, n - 1).bit_length()


class Index:
    """The index in a folder that driver and executors share; opened again, it has what was added to it. One session at a
    time may add. fan: runs of a level that are merged into one of the next."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, segment_bytes: int = SEGMENT_BYTES, fan: int = FAN):
        self.spark, self.path, self.segment_bytes, self.fan = spark, path.rstrip("/"), segment_bytes, fan
        self.journal = Journal(spark, f"{self.path}/journal")
        #: No fewer than the partitions that shuffles are set to, as buckets are what is merged apart.
        self.least = power_of_two(max(32, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        found, self.number = self.journal.newest()
        #: `batches`: folder, bytes and file buckets of each; `runs`: name and level of each; `buckets`: of the hash space.
        self.state = found or {"buckets": power_of_two(buckets) if buckets else None, "batches": [], "runs": []}

    def _commit(self, state: dict) -> None:
        if not self.journal.write(self.number, state):
            raise RuntimeError(f"another session adds to {self.path}")
        self.state, self.number = state, self.number + 1

    # tables that are bucketed in the store: the session knows them only while it needs them

    def _write(self, df: DataFrame, folder: str, column: str, buckets: int) -> None:
        name = f"lsm_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(buckets, column).option("path", f"{self.path}/{folder}").option("compression", "none").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")

    @contextlib.contextmanager
    def _table(self, folder: str, schema: str, column: str, buckets: int, partition: str = "") -> Iterator[DataFrame]:
        name = f"lsm_{uuid.uuid4().hex}"
        by = f"PARTITIONED BY ({partition})" if partition else ""
        self.spark.sql(f"CREATE TABLE {name} ({schema}{f', {partition} string' if partition else ''}) USING parquet {by} CLUSTERED BY ({column}) INTO {buckets} BUCKETS LOCATION '{self.path}/{folder}'")
        try:
            if partition:
                self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
            yield self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def _segments(self, batch: dict) -> DataFrame:
        with self._table(batch["folder"], SEGMENT, "part", batch["buckets"]) as table:
            return table

    def _write_segments(self, docs: DataFrame, number: int) -> dict:
        limit = self.segment_bytes

        def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part = (number << 32) | TaskContext.get().partitionId()
            segment, held, size = 0, [], 0

            def row() -> pa.RecordBatch:
                table = pa.Table.from_batches(held)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table)
                packed = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
                return pa.record_batch([pa.array([part], pa.int64()), pa.array([segment], pa.int64()), pa.array([size], pa.int64()), pa.array([packed], pa.binary())], names=["part", "segment", "n_bytes", "rows"])

            for whole in it:
                for piece in slices(whole, limit // 4):
                    held.append(piece)
                    size += piece.nbytes
                    if size >= limit:
                        yield row()
                        segment, held, size = segment + 1, [], 0
            if held:
                yield row()

        batch = {"folder": f"segments-{number:06d}-{uuid.uuid4().hex[:12]}", "buckets": self.least}
        self._write(batches(docs, rows, SEGMENT), batch["folder"], "part", batch["buckets"])
        return batch | {"bytes": self._segments(batch).agg(F.sum("n_bytes")).first()[0] or 0}

    def _write_run(self, segments: DataFrame, name: str, buckets: int) -> None:
        def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in one_by_one(it):
                hashes, several = of(row["rows"]).fingerprints()
                parts = bucketed(hashes, buckets)
                yield pa.record_batch([pa.array([b for b, _ in parts], pa.int32()), *(pa.array([row[k]] * len(parts), pa.int64()) for k in ("part", "segment")), pa.array([hashes[w].tobytes() for _, w in parts], pa.binary()), pa.array([bits(several[w]) for _, w in parts], pa.binary())], names=["bucket", "part", "segment", "hashes", "several"])

        self._write_bucketed(batches(segments, rows, RUN, slim=True), name, buckets)

    def _write_bucketed(self, run: DataFrame, name: str, buckets: int) -> None:
        self._write(run.repartition(buckets, "bucket").sortWithinPartitions("bucket", "part", "segment"), f"{self._runs_in(buckets)}/run={name}", "bucket", buckets)

    def _runs_in(self, buckets: int) -> str:
        return f"runs-{buckets}"

    def _compact(self) -> None:
        """Merges the runs of a level while there are `fan` of them. What is merged is left for readers that have it open."""
        while level := self._full_level():
            state = self.state
            merged = {"name": uuid.uuid4().hex[:12], "level": level[0]["level"] + 1}
            with self._table(self._runs_in(state["buckets"]), RUN, "bucket", state["buckets"], "run") as table:
                self._write_bucketed(table.filter(F.col("run").isin([r["name"] for r in level])).drop("run"), merged["name"], state["buckets"])
            self._commit(state | {"runs": [r for r in state["runs"] if r not in level] + [merged]})

    def _full_level(self) -> list[dict]:
        """The runs of the lowest level that has `fan` of them; none if there is no such level."""
        runs = self.state["runs"]
        of_level = [[r for r in runs if r["level"] == n] for n in sorted({r["level"] for r in runs})]
        return next((x for x in of_level if len(x) >= self.fan), [])

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds a batch and returns its rows with n_words, n_removed and kept (the words that stay, joined by one space).

        A word goes if a window that covers it also starts in a document with a smaller doc_id, of this batch or of an
        earlier one. A null text has no words; a null doc_id counts as larger than all others; rows with the same doc_id
        are not each other's repeats; an empty table gives none. Columns of `docs` that have the names of the three new
        ones are left out, all others are kept as they are."""
        docs = docs.drop("n_words", "n_removed", "kept")
        number = len(self.state["batches"])
        batch = self._write_segments(docs, number)
        # a fingerprint has eight bytes, and there is one for some thirty bytes of text
        total = sum(b["bytes"] for b in [*self.state["batches"], batch]) // 4
        buckets = self.state["buckets"] or max(self.least, power_of_two(total // BUCKET_BYTES))
        if total > 4 * BUCKET_BYTES * buckets:
            buckets = self._deal_anew(power_of_two(total // BUCKET_BYTES))
        run = {"name": uuid.uuid4().hex[:12], "level": 0}
        self._write_run(self._segments(batch), run["name"], buckets)
        state = self.state | {"buckets": buckets, "batches": [*self.state["batches"], batch], "runs": [*self.state["runs"], run]}
        found = self._resolve(state, docs)
        self._commit(state)
        self._compact()
        return found

    def _deal_anew(self, buckets: int) -> int:
        """All runs as one over more buckets; a bucket is a range of hashes, so each row of an old one is cut where new ones begin."""
        old = self.state

        def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in one_by_one(it):
                hashes = np.frombuffer(row["hashes"], "<u8")
                several, parts = unbits(row["several"], len(hashes)), bucketed(hashes, buckets)
                yield pa.record_batch([pa.array([b for b, _ in parts], pa.int32()), *(pa.array([row[k]] * len(parts), pa.int64()) for k in ("part", "segment")), pa.array([hashes[w].tobytes() for _, w in parts], pa.binary()), pa.array([bits(several[w]) for _, w in parts], pa.binary())], names=["bucket", "part", "segment", "hashes", "several"])

        if old["runs"]:
            merged = {"name": uuid.uuid4().hex[:12], "level": max(r["level"] for r in old["runs"])}
            with self._table(self._runs_in(old["buckets"]), RUN, "bucket", old["buckets"], "run") as table:
                self._write_bucketed(batches(table.filter(F.col("run").isin([r["name"] for r in old["runs"]])).drop("run"), rows, RUN), merged["name"], buckets)
            self._commit(old | {"buckets": buckets, "runs": [merged]})
        return buckets

    def _files(self, parts: list[int]) -> list[str]:
        """The files that hold the parts: a part is what one task wrote, and a file's name has its task's number."""
        wanted: dict[int, set[int]] = {}
        for p in parts:
            wanted.setdefault(p >> 32, set()).add(p & 0xFFFFFFFF)
        out = []
        for number, tasks in wanted.items():
            folder = f"{self.path}/{self.state['batches'][number]['folder']}"
            out += [f"{folder}/{f}" for f in self.journal.names(folder, ".parquet") if int(re.match(r"part-(\d+)-", f)[1]) in tasks]
        return out

    def _resolve(self, state: dict, docs: DataFrame) -> DataFrame:
        buckets, first = state["buckets"], (len(state["batches"]) - 1) << 32
        together = lambda df, name: kept(df.groupBy("part").agg(F.collect_list(F.struct("segment", "bucket", "bits")).alias(name)), name)
        own: Column = F.col("segment")
        # a part's rows each come with all that the part got; a segment takes its own
        told = lambda df, bits, name, how: df.join(bits, "part", how).withColumn(name, F.filter(name, lambda b: b["segment"] == own))

        with self._table(self._runs_in(buckets), RUN, "bucket", buckets, "run") as table:
            runs = table.filter(F.col("run").isin([r["name"] for r in state["runs"]])).drop("run")
            shared = together(runs.groupBy("bucket").applyInArrow(merge(first), BITS), "shared")

        def windows(row: dict) -> tuple[Segment, Windows]:
            segment = of(row["rows"])
            return segment, Windows(segment, in_order(row["shared"], segment.fingerprints()[0], buckets))

        def probe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in one_by_one(it):
                if not row["shared"]:
                    continue  # nothing to verify
                w = windows(row)[1]
                parts = bucketed(w.w0, buckets)
                yield pa.record_batch([pa.array([b for b, _ in parts], pa.int32()), *(pa.array([row[k]] * len(parts), pa.int64()) for k in ("part", "segment")), *(pa.array([x[p].tobytes() for _, p in parts], pa.binary()) for x in (w.w0, w.w1)), pa.array([narrow(w.least[p]) for _, p in parts], pa.binary())], names=["bucket", "part", "segment", "w0", "w1", "least"])

        segments = self._segments(state["batches"][-1]).select("part", "segment", "rows")
        candidates = batches(told(segments, shared, "shared", "inner").select("part", "segment", "rows", "shared"), probe, WINDOWS, slim=True)
        earlier = shared.filter(F.col("part") < first)
        if parts := [r[0] for r in earlier.select("part").collect()]:  # one number for each file that earlier batches left
            texts = self.spark.read.schema(SEGMENT).parquet(*self._files(parts)).select("part", "segment", "rows")
            candidates = candidates.unionByName(batches(told(texts, earlier, "shared", "inner").filter(F.size("shared") > 0).select("part", "segment", "rows", "shared"), probe, WINDOWS, slim=True))
        repeats = together(candidates.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(verify(first), BITS), "repeats")
        done = told(told(segments, shared, "shared", "left"), repeats, "repeats", "left")
        names = docs.columns
        kinds = pa.schema([(n, t) for n, t in zip(names, arrow_types(docs), strict=True)] + [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

        def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in one_by_one(it):
                segment, w = windows(row)
                gone = np.zeros(int(segment.ends[-1]) + 1, np.int32)
                starts = w.repeated(in_order(row["repeats"], w.w0, buckets))
                np.add.at(gone, starts, 1)
                np.add.at(gone, starts + WINDOW, -1)
                gone = np.cumsum(gone[:-1]) > 0
                kept, removed = [], []
                for d, words in enumerate(map(words_of, segment.texts)):
                    own = gone[segment.ends[d] : segment.ends[d + 1]]
                    removed.append(int(own.sum()))
                    kept.append((b" ".join([w for w, g in zip(words, own.tolist(), strict=True) if not g]) if removed[-1] else b" ".join(words)).decode("utf-8"))
                counts = np.diff(segment.ends)
                yield from unpacked(row["rows"]).append_column("n_words", pa.array(counts, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64())).append_column("kept", pa.array(kept, pa.string())).cast(kinds).to_batches(2000)

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_words long, n_removed long, kept string"
        return batches(done.select("part", "segment", "rows", "shared", "repeats"), finish, schema, slim=True)


def one_by_one(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows, of which only one is in Python at a time."""
    for batch in it:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def narrow(values: np.ndarray) -> bytes:
    """int64 values as the smallest of them and the differences to it, in as few bytes as they need."""
    low = int(values.min()) if len(values) else 0
    spread = int(values.max()) - low if len(values) else 0
    size = 1 if spread < 1 << 8 else 2 if spread < 1 << 16 else 4 if spread < 1 << 32 else 8
    return np.array([low], "<i8").tobytes() + (values - low).astype(f"<u{size}").tobytes()


def widen(data: bytes, n: int) -> np.ndarray:
    size = (len(data) - 8) // n if n else 1
    return np.frombuffer(data, "<i8", 1) + np.frombuffer(data, f"<u{size}", n, 8).astype(np.int64)


def arrow_types(docs: DataFrame) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return [f.type for f in to_arrow_schema(docs.schema)]


def dedup(docs: DataFrame, parts: int = BATCHES, **options) -> DataFrame:
    """All of `docs` put into a new index, in `parts` batches by ascending doc_id (of like sizes; null ones are in the last);
    see Index.add. A run of the second level is made on the way, as the index merges runs two by two."""
    index = Index(docs.sparkSession, scratch(docs.sparkSession, "lsm"), **{"fan": 2} | options)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    bounds = sorted(set(docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000)).first()[0] or [])) if parts > 1 else []
    ranges = zip([None, *bounds], [*bounds, None], strict=True)
    found = [index.add(docs.filter((key > low if low is not None else F.lit(True)) & (key <= high if high is not None else F.lit(True)))) for low, high in ranges]
    delete(docs.sparkSession, f"{index.path}/{index._runs_in(index.state['buckets'])}")  # no batch is to come, and results need no run
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: how many words of each document go, and a digest of what stays."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op10_substring_lsm": query}
