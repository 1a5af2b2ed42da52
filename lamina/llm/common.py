"""Helpers shared by the training-data operators: table access, shared storage, byte-level words."""

from __future__ import annotations

import gc
import getpass
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy step works on; a single longer text makes its own step.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only a session whose executors are in its own process, as in tests, may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file:///tmp/lamina-{getpass.getuser()}"
    return found


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write to the shared folder and read again, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing will read any more."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that nothing reads any more; else they stay until the driver happens to collect its garbage.

    The session holds on to its last query until the next one, and Python's references are given back by a
    thread of their own: hence an empty query, and two rounds.
    """
    spark.range(0).collect()
    for _ in range(2):
        gc.collect()
        time.sleep(0.2)
        spark._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- text as bytes


def as_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most that many bytes; a longer row stands alone."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def table_of(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Digits, letters and all non-ASCII bytes; in UTF-8 a byte of 0x80 or more is always part of a non-ASCII character.
ALNUM_WORD = table_of((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Everything but space and the controls 9 to 13.
SPACED_WORD = ~table_of((0x20, 0x20), (0x09, 0x0D))

_MULT = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 1024), _MULT, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: one to one on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(buf: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words; kind tells word bytes; no word crosses documents."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    is_word = kind[buf]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    cut = offs[:-1]
    cut = cut[cut < offs[1:]]
    first[cut] = is_word[cut]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    last[cut[1:] - 1] = is_word[cut[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, step: int = 1 << 16) -> np.ndarray:
    """A 64-bit hash of each word's (lower-cased) bytes, so many words at a time: their bytes take 8 bytes each here, several times over."""
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), step):
        first, size = starts[a : a + step], ends[a : a + step] - starts[a : a + step]
        at = np.cumsum(size) - size
        pos = np.arange(int(size.sum())) - np.repeat(at, size)
        src = buf[np.repeat(first, size) + pos]
        vals = (LOWER[src] if lower else src).astype(np.uint64)
        vals += np.uint64(1)
        vals *= powers(int(size.max()))[pos]
        out[a : a + step] = mix(np.add.reduceat(vals, at) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def columns(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]
