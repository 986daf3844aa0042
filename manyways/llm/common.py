"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

_made: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Only a session that is one machine gets a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="manyways-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, tag: str, records: int | None = None, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and outlives lost executors. records: how many rows Python workers
    get at once; the session's own number counts rows, however long their texts are. by: a column of few values, each in a folder of its own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/manyways/{tag}-{uuid.uuid4().hex}"
    freed = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # what is written needs its shuffle files no longer
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = {freed: spark.conf.get(freed, "false"), batch: spark.conf.get(batch)}
    spark.conf.set(freed, "true")
    if records:
        spark.conf.set(batch, str(records))
    try:
        df.write.parquet(path, partitionBy=by)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    _made[path] = spark
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more, also not lazily."""
    for t in tables:
        _delete(_made.pop(t._written), t._written)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for path, spark in _made.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before; the folder stays for the cluster's own clean-up
            return


@contextlib.contextmanager
def released():
    """Gives freed memory back to the system at the end: Python workers live on from task to task, and what one kept would count on."""
    import pyarrow as pa

    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
            ctypes.CDLL(None).malloc_trim(0)


def trimmed(step):
    """A step of mapInArrow that ends with released()."""

    def run(batches):
        with released():
            yield from step(batches)

    return run


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal text of doc_id, modulo n; null counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % n


def buffers(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, int64 offsets (n + 1) and a null mask of an Arrow string or binary array, without a copy of the bytes."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    nulls = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else np.zeros(n, bool)
    return b[o[0] : o[-1]], o - o[0], nulls


MULT = 0x9E3779B97F4A7C15
INV = pow(MULT, -1, 1 << 64)
_pow = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of MULT and of its inverse modulo 2**64."""
    global _pow
    if len(_pow[0]) < n:
        size = max(n, 1 << 16)
        _pow = tuple(np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, m, np.uint64)))) for m in (MULT, INV))
    return _pow[0][:n], _pow[1][:n]


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """Sums of (b[i] + 1) * MULT**i before each position, modulo 2**64."""
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(len(b))[0], out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) that don't depend on where they stand."""
    return mixed((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
