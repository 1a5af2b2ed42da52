"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Row i of the table (in the order of its id, then of size and checksum) goes to place p = permute(i),
shard p mod n and slot p div n. So shards differ by a row at most, slots are gapless, and both the
place of a row and the row at a place can be computed without a table.

Defined cases: a null text has size 1 and checksum 0; a null id comes first; repeated rows are
numbered one after another (they are interchangeable); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import materialize, mix, shuffle_width

ROUNDS = 4
SEED = 20240117


def _half_bits(n: int) -> int:
    """Half the bits of the smallest square domain that holds n numbers."""
    return max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)


def _feistel(x: np.ndarray, half: int, seed: int, rounds: range) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for r in rounds:
        key = np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64))
        if rounds.step > 0:
            left, right = right, left ^ (mix(right + key) & mask)
        else:
            left, right = right ^ (mix(left + key) & mask), left
    return (left << np.uint64(half)) | right


def permute(rows: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """A permutation of 0..n-1: walk the cycle of the wider Feistel domain until the value is below n."""
    half = _half_bits(n)
    rounds = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    out = np.asarray(rows).astype(np.uint64)
    if n <= 1:
        return out.astype(np.int64)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = _feistel(out[todo], half, seed, rounds)
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def locate(row: int, n: int, n_shards: int, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of a global row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % n_shards, p // n_shards


def row_at(shard: int, slot: int, n: int, n_shards: int, seed: int = SEED) -> int:
    """The global row number at a shard's slot."""
    return int(permute(np.array([slot * n_shards + shard]), n, seed, inverse=True)[0])


def number_rows(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """Gapless numbers `row_no` in the given order, and their count.

    Ranges are sorted in parallel; only one count per partition meets in one place.
    """
    spark = df.sparkSession
    mid = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    kept, _ = materialize(ranged.withColumn("_mid", mid), "rows")
    kept = kept.withColumn("_part", F.shiftright("_mid", 33))
    counts = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"),
    )
    total = counts.agg(F.sum("_n")).first()[0] or 0
    # one row for each shuffle partition: a size that is fixed by configuration
    out = kept.join(F.broadcast(before), "_part").withColumn("row_no", F.col("_before") + F.col("_mid").bitwiseAND((1 << 33) - 1))
    return out.drop("_mid", "_part", "_before"), int(total)


def assign_shards(docs: DataFrame, n_shards: int = 16, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, row_no, shard, slot. Texts stay where they are read."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    sized = docs.select(
        F.col(id_col).alias(id_col),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    numbered, n = number_rows(sized, id_col, "size", "text_crc32")

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(permute(s.to_numpy(np.int64), n, seed))

    return numbered.withColumn("_place", place("row_no")).select(
        id_col,
        "size",
        "text_crc32",
        "row_no",
        F.pmod("_place", F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(F.col("_place") / n_shards).cast("long").alias("slot"),
    )
