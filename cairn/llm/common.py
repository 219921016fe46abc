"""What the operators share: reading documents, the shared scratch folder, and Arrow batch maps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import sys
import tempfile
import time
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that goes to a Python worker.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: glibc's number for the size from which a block is mapped by itself, and that size for lean workers.
MMAP_THRESHOLD, MAPPED = -3, 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table `documents`, read by Spark (the folder may be one that only Spark reaches)."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master without it a new temporary folder."""
    sc = spark.sparkContext
    if set_dir := sc.getConf().get("spark.checkpoint.dir"):
        return set_dir.rstrip("/")
    if made := sc.getCheckpointDir():
        return made.rstrip("/").rpartition("/")[0]
    if not re.match(r"local($|\[)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="scratch-"))
    return shared_dir(spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is written there stays until the folder is cleared: results are read from it lazily."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: What kept() has written, for each call of only() that is under way.
MADE: list[list[str]] = []


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def only(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `make` gives, kept; what it kept on the way is deleted, as nothing reads it any more."""
    MADE.append([])
    try:
        out = make()
    finally:
        made = MADE.pop()
    result = kept(out, name)
    for path in made:
        delete(result.sparkSession, path)
    return result


#: Seconds from one settle() of kept() to the next, and when each session's context last did.
SETTLE_S = 30
SETTLED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def trimmed(spark: SparkSession) -> str:
    """Has the driver's JVM give its free native memory back to the system: plans are made on many threads, each with a pool that
    keeps what it had. What the JVM says of it; empty where it has no such command."""
    with contextlib.suppress(Exception):  # other JVMs
        jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
        args = new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface, as the server's own class is not open to callers
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        return str(call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args))
    return ""


def settle(spark: SparkSession, spacing: float = 0) -> None:
    """Executors collect their garbage now, in a task for each core, and so does the driver. A heap that a step has grown, and the
    direct buffers of its readers and writers, otherwise stay with the executor while later steps start workers beside them; a
    full collection gives both back to the system. The driver's heap grows with the plans and tasks of each step, and Python's
    own garbage holds plans there. It changes no result, and where collecting on request is disabled it does nothing.
    spacing: not if the last time is fewer seconds ago."""
    sc = spark.sparkContext
    if time.monotonic() - SETTLED.get(sc, -spacing) < spacing:
        return
    gc.collect()
    spark._jvm.System.gc()
    trimmed(spark)
    n = max(1, sc.defaultParallelism)
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()
    SETTLED[sc] = time.monotonic()


def kept(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: lineage is cut, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    if MADE:
        MADE[-1].append(path)
    df.write.options(**options).parquet(path)
    settle(df.sparkSession, SETTLE_S)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null as empty) and the columns named; other columns of `docs`, whatever their names, go no further."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


#: Sessions' contexts that have this package.
SENT: weakref.WeakSet = weakref.WeakSet()


def send_package(spark: SparkSession) -> None:
    """Python workers get this package from the driver, as an archive, so it need not be installed where they run."""
    if (sc := spark.sparkContext) in SENT:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    path = list(sys.path)
    sc.addPyFile(str(archive))
    sys.path[:] = path  # the driver goes on with the package that it has
    SENT.add(sc)


def ddl(docs: DataFrame, names: list[str]) -> str:
    """The columns `names` as they stand in a schema's text."""
    return "".join(f", `{n}` {docs.schema[n].dataType.simpleString()}" for n in names)


def batches(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, batch_rows: int = 1000, slim: bool = False) -> DataFrame:
    """`rows` over each partition's Arrow batches, which are kept small, as texts differ much in length. The setting for that
    is the session's, so it holds until the next call of this. slim: workers are made lean() first."""
    send_package(df.sparkSession)
    df.sparkSession.conf.set(BATCH_ROWS, str(batch_rows))

    task = rows.__module__

    def and_release(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering(task)
        if slim:
            lean()
        yield from rows(it)
        release()

    return df.mapInArrow(and_release, schema)


#: What frees the things that a worker holds from task to task, and the module whose task it did last.
LET_GO: list[Callable[[], None]] = []
LAST = ""


def entering(task: str) -> None:
    """A worker that goes on to another module's tasks lets go of what it held for the last one's."""
    global LAST
    if task != LAST:
        for clear in LET_GO:
            clear()
        LAST = task


def lean() -> None:
    """From now on what this worker frees of large blocks goes back to the system at once: by itself glibc raises the size from
    which it maps them, and Arrow's own pool keeps what it had, so a worker holds its peaks of all steps until its task ends."""
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).mallopt(MMAP_THRESHOLD, MAPPED)
        pa.set_memory_pool(pa.system_memory_pool())


def release() -> None:
    """Gives free memory back to the system: workers live on and share an executor's memory with those of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `limit` bytes, so what Python holds of very long texts stays small."""
    if batch.nbytes <= limit or batch.num_rows <= 1:
        yield batch
        return
    step = max(1, batch.num_rows * limit // batch.nbytes)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
