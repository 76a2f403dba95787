"""What the operators of this subpackage share: reading, scratch tables, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package

#: Rows of one Arrow batch, and bytes of text that one numpy step works on.
BATCH_ROWS = 1000
SLICE_BYTES = 1 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster: spark.checkpoint.dir, else the context's checkpoint folder.

    On one machine, as in tests, a folder under /tmp does where neither is set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "/tmp/checkpoints/siftwell"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later jobs don't depend on lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read again, so that a step of many tables doesn't keep them all on disk."""
    for table in tables:
        path = table.__dict__.pop("scratch_path", None)
        if path:
            jvm = table.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def scratch_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/siftwell/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables. Only results that are written, and read from there, hold after this."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that Spark deletes the shuffle files and broadcasts of jobs that are over.

    In a step of many jobs they, and the classes generated for their plans, would else stay until the heap is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """The same rows as a table in which each keeps its place, job after job: a plain scan as it is, all else written."""
    fix_splits(df.sparkSession)
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        plan = plan.child()
    return df if plan.nodeName().startswith(("LogicalRelation", "Relation")) else scratch(df, "settled")


#: What workers keep from task to task, by name.
_caches: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    return _caches.setdefault(name, {})


def lean(work: Callable, *keep: str) -> Callable:
    """A function of batches that first drops the worker's caches but those to keep, and frees its memory at the end.

    Workers live on after a task; without this they would hold what the C library and Arrow keep for later.
    """

    def run(batches):
        forget(keep)
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def forget(keep: tuple[str, ...]) -> None:
    for name, cache in _caches.items():
        if name not in keep:
            cache.clear()


def trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def fix_splits(spark: SparkSession) -> None:
    """Make every scan of a table be split alike, whatever executors come and go.

    A row's place in the scan serves as its key across jobs; unless told, Spark splits by the cores it has just now.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def arrow_limits(spark: SparkSession) -> None:
    """Bound what one Arrow batch may hold, since single texts can be very long; ready the executors' Python."""
    ship_package(spark)
    fix_splits(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and whole text; null counts as empty. Other columns, of any name, play no part."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def with_key(docs: DataFrame) -> DataFrame:
    """texts() and row_key, unique per row even where doc_id repeats or is null.

    The key is the row's place in the scan, so a retried task gives the same keys.
    """
    return texts(docs).select(F.monotonically_increasing_id().alias("row_key"), "doc_id", "text")


def place_column(docs: DataFrame) -> str:
    """A name for a row's place that no column of docs has."""
    name = "row_place"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def only_rows(docs: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of docs, with its columns, whose place is among keys (row_key). docs is settled(), keys without repeats."""
    place = place_column(docs)
    keyed = docs.withColumn(place, F.monotonically_increasing_id())
    return keyed.join(keys.select(F.col("row_key").alias(place)), place, how).select(*docs.columns)


def without_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    return only_rows(docs, keys, "left_anti")


#: A key is looked up apart where one in so many rows, or more, have it; so there are no more such keys than that.
HOT_SHARE = 1000


def look_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows left-joined with table, which has each key once, when some keys may have any share of the rows.

    rows is a written table, as it is read more than once. Keys of a HOT_SHARE-th of its rows or more come with their
    values as a broadcast of HOT_SHARE rows at most; all others are joined by key. Null keys find nothing.
    """
    least = rows.count() / HOT_SHARE
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(key)
    hot = scratch(hot.join(table, key, "left").limit(HOT_SHARE), "hot")
    apart = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key, "left")
    return apart.unionByName(rest)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, first one 0) and bytes of a string or binary column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    start = column.offset
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[start : start + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most about limit bytes (one row at least): first row, end row, offsets, bytes."""
    off, data = buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, off[lo : hi + 1] - off[lo], data[off[lo] : off[hi]]
        lo = hi


#: Entries that ragged() gathers at a time, so that its numbers stay in the processor's cache.
GATHERED = 1 << 17


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate flat[starts[i] : starts[i] + lengths[i]] over i."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return flat[:0]
    out, shift = np.empty(total, flat.dtype), starts - (ends - lengths)
    lo = at = 0
    while at < total:
        hi = max(lo + 1, int(np.searchsorted(ends, at + GATHERED, "right")))
        to = int(ends[hi - 1])
        where = np.repeat(shift[lo:hi], lengths[lo:hi])
        where += np.arange(at, to)
        out[at:to] = flat[where]
        lo, at = hi, to
    return out


def crc_mod(column: str, mod: int):
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def ascii_lower(column):
    return F.translate(column, UPPER, UPPER.lower())
