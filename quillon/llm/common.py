"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the word contracts define it.
SPACE = r"[\x20\x09-\x0D]+"
#: Characters outside the words of the decontamination contract, after lower-casing.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A side of at most so many rows and, as JSON text, bytes may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir or the context's checkpoint folder. Where
    neither is set a session in one process (tests) gets a temporary folder; a cluster cannot share one, so that
    is an error there."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "quillon-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, for one run's files. It goes when the application ends, unless the
    process is killed first."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def scratch_root(spark: SparkSession) -> str:
    """Where tasks may put files of their own: the shared folder if it is mounted as a path, else (empty) the folders that
    the cluster gives Spark's own spills."""
    url = urlparse(shared_dir(spark))
    return url.path if url.scheme in ("", "file") else ""


def task_folder(root: str) -> tempfile.TemporaryDirectory:
    """A folder for one task's files, which goes with it."""
    root = root or os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    if not root:
        raise ValueError("the shared folder is no mounted path, and SPARK_LOCAL_DIRS is not set")
    os.makedirs(root, exist_ok=True)
    return tempfile.TemporaryDirectory(dir=root, prefix="task-")


def load_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small file in whichever file system holds it; None if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def save_bytes(spark: SparkSession, path: str, raw: bytes) -> None:
    """Write a small file so that it appears whole; a file that another writer put there meanwhile stays."""
    part, at = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.{uuid.uuid4().hex}", path))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part)
    out.write(bytearray(raw))
    out.close()
    if fs.exists(at) or not fs.rename(part, at):
        fs.delete(part, False)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def computed(df: DataFrame) -> DataFrame:
    """df with a column `_computed` that is never negative. A filter that names it stays above the columns of
    df; otherwise Spark pushes the filter below them and evaluates their expressions once more, in lambdas
    even once per element."""
    return df.withColumn("_computed", F.monotonically_increasing_id())


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """df written to the shared folder as a table in buckets of `key`, as many as shuffles have partitions: the
    lineage is cut, and grouping by key afterwards does not shuffle the rows again."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    table = f"quillon_{path.rsplit('-', 1)[1]}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).option("path", path).option("compression", "none").saveAsTable(table)
    return spark.table(table)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and reread. Other than a checkpoint it does not keep the partitioning, so
    that a join shuffles it and adaptive execution can split the other side's hot keys."""
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", "none").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Let the cleaner remove the shuffle files of plans that nobody holds any more, which else stay until the
    driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def to_bytes(values: pa.Array) -> bytes:
    """An Arrow array of any type, compressed, for a binary column."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("x", values.type)]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_arrays([values], names=["x"]))
    return sink.getvalue().to_pybytes()


def from_bytes(raw: bytes) -> list:
    return pa.ipc.open_stream(raw).read_all().column("x").to_pylist()


def is_small(df: DataFrame) -> bool:
    """Whether df may be broadcast. Its first rows are counted and measured, so df should be cheap to compute."""
    n, size = df.limit(BROADCAST_ROWS + 1).select(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("x")).agg(F.count(F.lit(1)), F.sum("x")).first()
    return n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def join_small(big: DataFrame, small: DataFrame, on: Column, how: str = "left") -> DataFrame:
    """Join a side that is expected to be small: broadcast where it is, and beyond that a join that Spark shuffles, whose
    hot keys adaptive execution splits."""
    return big.join(F.broadcast(small) if is_small(small) else small, on, how)


def words(text: Column) -> Column:
    """Maximal runs without white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. lower() is exact where no other character changes case; the slower
    translate() serves the texts with capitals beyond ASCII."""
    other = text.rlike(r"[\p{Lu}\p{Lt}\p{Nl}\p{So}\p{Cn}&&[^\x00-\x7F]]")
    return F.when(other, F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def trim() -> None:
    """Give a worker's free memory back to the system. Spark keeps idle workers for a minute, and what they hold counts
    against the executor that the next stage needs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """A function for mapInArrow that trims when its task ends."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


_HELD: dict = {}


def in_worker(key, make: Callable):
    """What make() gives, kept in a worker process for later tasks. A worker keeps one such thing: asking for
    another drops it, so that the caches of different operators never add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


_SEED = np.random.default_rng(20_240_607)
_BYTE = _SEED.integers(0, 1 << 64, 256, dtype=np.uint64)
_POWER = np.ones(1 << 12, np.uint64)
_SPACE = np.isin(np.arange(256), (0x20, *range(0x09, 0x0E)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words, in order: polynomials over a random number per byte. bytes.lower() touches A-Z
    alone, and words are what lies between 0x20 and 0x09-0x0D."""
    global _POWER
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    lengths = edges[1::2] - edges[::2]
    if not len(lengths):
        return np.empty(0, np.uint64)
    longest = int(lengths.max())
    if longest > len(_POWER):
        _POWER = np.ones(2 * longest, np.uint64)
    if _POWER[-1] == 1:
        _POWER[1:] = 0x9E3779B97F4A7C15
        np.cumprod(_POWER, out=_POWER)
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    return mix(np.add.reduceat(_BYTE[raw[inside]] * _POWER[place], first) + lengths.astype(np.uint64))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside a lambda Spark evaluates a whole expression for each
    element, and only bound variables and attributes are free."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, add: Callable[[Column, Column], Column], chunk: int = 256) -> Column:
    """Inclusive running results of `add` (associative; 0 changes nothing) over a non-empty array of longs, in chunks so that
    the copying stays near-linear."""
    zero = F.array(F.lit(0).cast("long"))

    def sums(a: Column) -> Column:
        grown = F.aggregate(a, zero, lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x))))
        return F.slice(grown, 2, F.size(a))

    def whole(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int")), lambda k: sums(F.slice(v, k * chunk + 1, chunk)))
        return let(parts, lambda p: let(before(p), lambda b: F.flatten(F.transform(p, lambda q, k: F.transform(q, lambda x: add(x, F.element_at(b, k + 1)))))))

    def before(p: Column) -> Column:
        return F.aggregate(p, zero, lambda acc, q: F.concat(acc, F.array(add(F.element_at(acc, -1), F.element_at(q, -1)))))

    return let(values, whole)


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    """For longs of 0 or more."""
    return running(values, F.greatest)
