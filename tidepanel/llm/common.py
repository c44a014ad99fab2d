"""Pieces shared by the training-data operators.

Text leaves Spark as Arrow batches.  ``blocks`` cuts a batch into byte blocks
of whole documents, small enough for numpy arrays to stay in the processor's
cache, and ``Words`` finds the words of a block without a Python loop.

A word is a longest run of bytes other than space and the controls 9 to 13.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
_local_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a fresh one of this machine where a local session names none (tests)."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local_dir:
        _local_dir.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return _local_dir[0]


def shared_path(spark: SparkSession, name: str) -> str:
    """A place for a new table in the shared folder."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(spark: SparkSession, df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs do not recompute it, and a lost executor costs nothing."""
    path = path or shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(column: str, n: int):
    """crc32 of the number as text, modulo n (null ids: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def crc32_text(value: int) -> int:
    return zlib.crc32(str(value).encode())


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(column, limit: int = BLOCK_BYTES):
    """(first row, past the last row, bytes, offsets) of runs of whole documents of about ``limit`` bytes; a longer document stands alone."""
    data, at = text_buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """Words of a block: ``start`` and ``end`` byte positions, ``doc`` index in the block, ``first`` word of each document (with an end mark)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = ~SEPARATOR[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = ~inside[:-1]
        edge[offsets] = True  # a word never runs over from one document to the next
        self.start = np.flatnonzero(inside & edge[:-1])
        edge[1:-1] = ~inside[1:]
        edge[-1] = True
        edge[offsets] = True
        self.end = np.flatnonzero(inside & edge[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finish for 64-bit hashes, so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A code of two codes in this order.  Mixing comes between them, so no sum of terms can cancel."""
    return mix(mix(x + np.uint64(0x9E3779B97F4A7C15)) + y)


LONG_WORD = 2048


def word_codes(data: np.ndarray, words: Words) -> np.ndarray:
    """64-bit codes of words: a word of up to seven bytes is its own code, so no two of them collide; a longer one is hashed eight bytes at a time, below 2**63 + 2**62."""
    if not len(words):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data),), "<u8", padded, strides=(1,))
    length = words.end - words.start
    keep = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    first = eight[words.start] & keep[np.minimum(length, 8)]
    out = first | (length.astype(np.uint64) << np.uint64(56))
    long = np.flatnonzero(length > 7)
    if len(long):
        h = pair(first[long], length[long].astype(np.uint64))
        rest, at = np.flatnonzero((length[long] > 8) & (length[long] <= LONG_WORD)), 8
        while len(rest):
            which = long[rest]
            left = length[which] - at
            h[rest] = pair(h[rest], eight[words.start[which] + at] & keep[np.minimum(left, 8)])
            rest, at = rest[left > 8], at + 8
        for i in np.flatnonzero(length[long] > LONG_WORD).tolist():
            whole = data[words.start[long[i]] : words.end[long[i]]].tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little")
        out[long] = (h >> np.uint64(2)) | np.uint64(1 << 63)
    return out


def run_codes(codes: np.ndarray, *widths: int) -> list[np.ndarray]:
    """For each width the codes of all runs of that many neighbours, joined from runs of powers of two."""
    out: list = [None] * len(widths)
    done = [0] * len(widths)
    power, size = codes, 1
    while True:
        for k, width in enumerate(widths):
            if width & size:
                n = max(0, len(codes) - width + 1)
                have = power[done[k] : done[k] + n]
                out[k] = have if out[k] is None else pair(out[k][:n], have)
                done[k] += size
        if 2 * size > max(widths) or len(power) <= size:
            break
        power, size = pair(power[:-size], power[size:]), 2 * size
    return [x[: max(0, len(codes) - w + 1)] if x is not None and d == w else np.zeros(0, np.uint64) for x, w, d in zip(out, widths, done, strict=True)]


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... of ``count[0]`` numbers, then those of start[1], and so on."""
    total = int(count.sum())
    before = np.cumsum(count) - count
    return np.arange(total) - np.repeat(before, count) + np.repeat(start, count)
