"""What the corpus operators share: reading, batching, hashing and cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel holds at once; it bounds a worker's memory whatever the batch size.
SLICE_BYTES = 6_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ------------------------------------------------------------------ shared storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is named (tests)."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tabulith-")
        sc.setCheckpointDir(where)
        where = sc.getCheckpointDir()
    return where


_written: list[tuple[SparkSession, str]] = []


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@atexit.register
def _drop_all() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            if spark.sparkContext._jsc is not None:
                delete_path(spark, path)
        except Exception:  # the session may be gone at exit
            return


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/tabulith/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there and a lost
    executor costs a re-read, not a recomputation. Removed when the process ends."""
    spark = df.sparkSession
    release(spark)
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tabulith_path = path
    del df, writer  # else the shuffles behind them could not go
    release(spark)
    return out


#: Bytes of Parquet that a side may have to be broadcast; a larger one is joined by shuffled hash.
BROADCAST_BYTES = 4_000_000


def small_or_hashed(df: DataFrame) -> DataFrame:
    """What ``materialize`` wrote, hinted as a broadcast if its files are small, else as the built side of a shuffled join."""
    jvm = df.sparkSession.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(df._tabulith_path)
    size = p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return df.hint("broadcast" if size <= BROADCAST_BYTES else "shuffle_hash")


def drop(df: DataFrame) -> None:
    """Remove what ``materialize`` wrote, once nothing reads it any more."""
    delete_path(df.sparkSession, df._tabulith_path)


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files of jobs that are over."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------------ columns and batches


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns of any name can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of every value; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_slices(batches, text: str = "text", size: int = SLICE_BYTES, rows: int = 1_000_000):
    """(batch slice, its texts as bytes) with at most ``size`` bytes of text and ``rows`` rows, or one row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        if batch.num_rows == 0:
            continue
        lengths = np.array([x or 0 for x in pa.compute.binary_length(col).to_pylist()], dtype=np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = min(max(start + 1, int(np.searchsorted(ends, base + size, side="right"))), start + rows)
            part = batch.slice(start, stop - start)
            yield part, as_bytes(part.column(part.schema.get_field_index(text)))
            start = stop


def give_back(collect: bool = True) -> None:
    """Return a worker's free memory to the system: workers are kept for other stages' tasks."""
    import ctypes
    import gc

    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def thrifty(kernel):
    """The batch kernel, giving memory back when it ends."""

    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def in_worker(name: str, make):
    """What ``make`` gives, made once in a Python worker and kept until another name is asked for:
    a worker serves many stages, and holds the memory of one."""
    import sys
    import types

    kept = sys.modules.setdefault("_tabulith_worker", types.ModuleType("_tabulith_worker")).__dict__
    if name not in kept:
        for old in [k for k in kept if not k.startswith("__")]:
            del kept[old]
        kept[name] = make()
    return kept[name]


# ------------------------------------------------------------------ hashing

MIX = np.uint64(0xBF58476D1CE4E5B9)
GOLD = np.uint64(0x9E3779B97F4A7C15)
#: ASCII upper to lower case, the rest as it is.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def word_hasher(limit: int = 300_000):
    """word (bytes) -> 64-bit hash, remembered for up to ``limit`` words at a time."""
    import xxhash

    class Hashes(dict):
        def __missing__(self, word):
            if len(self) >= limit:
                self.clear()
            value = self[word] = xxhash.xxh3_64_intdigest(word)
            return value

    return Hashes().__getitem__


def mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(29))) * MIX
    return a ^ (a >> np.uint64(32))


# ------------------------------------------------------------------ keys in buckets

#: Buckets from which a 56-bit key needs six bytes beside its bucket's start.
LEAST_BUCKETS = 300


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of 56-bit keys, in the keys' order."""
    return ((keys >> np.uint64(24)) * np.uint64(buckets)) >> np.uint64(32)


def bucket_start(bucket: int, buckets: int) -> np.uint64:
    return np.uint64(-(-(bucket << 32) // buckets) << 24)


def pack_keys(keys: np.ndarray, start: np.uint64) -> bytes:
    return np.ascontiguousarray((keys - start).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    """Packed keys, beside their bucket's start."""
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def order_of(codes: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of codes below 2 ** bits: code and place in one number sort faster than an argsort."""
    place = max(1, int(len(codes) - 1).bit_length())
    if bits + place > 64:
        return np.argsort(codes, kind="stable")
    packed = (codes.astype(np.uint64) << np.uint64(place)) | np.arange(len(codes), dtype=np.uint64)
    packed.sort()
    return (packed & np.uint64((1 << place) - 1)).astype(np.int64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts that are mostly small: a byte each, and the large ones in full behind them."""
    large = counts[counts >= 255].astype("<u8")
    return len(large).to_bytes(4, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    end = len(raw) - 8 * n
    out = np.frombuffer(raw[4:end], np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[end:], "<u8").astype(np.int64)
    return out
