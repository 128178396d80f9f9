"""Small helpers shared by the training-data operators."""

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bound_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Let Spark hand text to Python workers in batches of at most ``limit`` bytes (or one row).

    A batch exists several times over on its way through a task; Spark's own bound is 64 MB.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def worker_state(key, build: Callable):
    """A value kept for the life of a Python worker process.

    Function bodies are shipped by value, so module globals live for one task only;
    vocabularies and bounded memo tables are worth keeping between tasks.
    """
    kept = sys.__dict__.setdefault("_corpuskit_worker_state", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]


def crc_remainder(column: str, divisor: int) -> Column:
    """crc32 of the value written as text, modulo ``divisor``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(divisor))


def binary_values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def by_bytes(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most ``limit`` bytes, but at least one item each."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def joined(values: list[bytes], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One byte array with ``gap`` zero bytes after each value; starts and lengths."""
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    starts = np.zeros(len(values), np.int64)
    if len(values):
        np.cumsum(lengths[:-1] + gap, out=starts[1:])
    pad = bytes(gap)
    return np.frombuffer(pad.join(values) + pad, np.uint8), starts, lengths


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


WINDOW = 16  # bytes under one window hash


def _words(data: np.ndarray, count: int) -> np.ndarray:
    """The eight bytes at each of the first ``count`` positions, as numbers."""
    out = np.empty(count, np.uint64)
    for shift in range(8):
        some = (count - shift + 7) // 8
        if some > 0:
            out[shift::8] = np.frombuffer(data[shift : shift + 8 * some].tobytes(), "<u8")
    return out


def window_hashes(data: np.ndarray, count: int) -> np.ndarray:
    """64-bit hashes of the 16 bytes at each of ``count`` positions; 15 more bytes must follow the last."""
    words = _words(data, count + 8)
    left = words[:count] * np.uint64(0x9FB21C651E98DF25)
    left ^= left >> np.uint64(35)
    left += words[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(left)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
