"""A bounded shuffle buffer over a stream of rows: seeded draws from a buffer per lane, kept as state that survives restarts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegralType, StructField, StructType

END = "end_of_lane"
ADDED = ("lane", "position", "batch")


def draw(seed: int, lane: int, k: int) -> int:
    """The k-th number of a lane, 64 mixed bits of (seed, lane, k): nothing but k has to be remembered."""
    return int(np.random.SeedSequence((seed % (1 << 64), lane, k)).generate_state(1, np.uint64)[0])


def write_rows(df: DataFrame, folder: str) -> None:
    """Add rows of an epoch to the folder that a stream reads."""
    _own(df)
    df.withColumn(END, F.lit(None).cast("int")).write.mode("append").parquet(folder)


def end_epoch(spark: SparkSession, folder: str, schema: StructType | str, lanes: int) -> None:
    """Say that no more rows of this epoch come: every lane hands out what its buffer still holds. Call it after the rows are written."""
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields]
    spark.range(lanes).coalesce(1).select(*columns, F.col("id").cast("int").alias(END)).write.mode("append").parquet(folder)


def read_rows(spark: SparkSession, folder: str, schema: StructType | str, per_batch: int = 8) -> DataFrame:
    """The folder as a stream, oldest files first."""
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return spark.readStream.schema(StructType([*wanted.fields, *StructType.fromDDL(f"{END} int").fields])).option("maxFilesPerTrigger", per_batch).parquet(folder)


def buffered(rows: DataFrame, order: list[str], size: int, batch: int, seed: int, lanes: int = 64) -> DataFrame:
    """Rows in a shuffled order: (lane, position, batch) and the row.

    Rows are dealt to lanes by a hash of `order`, which should tell rows apart. Within a lane and micro-batch they are taken by `order`
    (nulls first). A lane's buffer fills up to `size`; then each row that comes in pushes out one drawn from it, so `size` rows
    stay after every draw (min_after_dequeue) until the epoch ends. position counts a lane's draws without gaps, over epochs as well; `batch` of
    them make a batch. State is at most `size` rows a lane. Every row comes out once an epoch, equal rows as often as
    they came in; what a lane hands out depends on the rows and their micro-batches only, so a restart goes on as if there had been none.
    """
    if size < 1 or batch < 1 or lanes < 1:
        raise ValueError("size, batch and lanes are 1 at least")
    given = StructType([f for f in rows.schema.fields if f.name != END])
    _own(given)
    # pandas has no null in whole numbers: they go along as 0 and a flag, so that none is rounded
    whole = [f.name for f in given.fields if isinstance(f.dataType, IntegralType)]
    flags = {n: f"_null_{n}" for n in whole}
    by = [c for n in order for c in ((flags[n], n) if n in flags else (n,))]
    rising = [c not in flags.values() for c in by]
    filled = StructType([*given.fields, *[StructField(n, BooleanType()) for n in flags.values()]])
    kept = to_arrow_schema(filled)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        lane = int(key[0])
        blob, taken = state.get if state.exists else (None, 0)
        new = pd.concat(list(batches), ignore_index=True)
        ended = bool(new[END].notna().any())
        new = new[new[END].isna()].sort_values(by, ascending=rising, kind="stable", na_position="first")[filled.names]
        held = None if blob is None else pa.ipc.open_stream(blob).read_all()
        arrived = pa.Table.from_pandas(new, kept, preserve_index=False)
        pool = arrived if held is None else pa.concat_tables([held, arrived])
        buffer, out = list(range(0 if held is None else held.num_rows)), []
        for k in range(len(buffer), pool.num_rows):
            if len(buffer) < size:
                buffer.append(k)
                continue
            j = draw(seed, lane, taken + len(out)) % size
            out.append(buffer[j])
            buffer[j] = k
        while ended and buffer:
            j = draw(seed, lane, taken + len(out)) % len(buffer)
            out.append(buffer[j])
            buffer[j] = buffer[-1]
            buffer.pop()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kept) as w:
            w.write_table(pool.take(pa.array(buffer, pa.int64())))
        state.update((sink.getvalue().to_pybytes(), taken + len(out)))
        got = pool.take(pa.array(out, pa.int64())).to_pandas()
        position = np.arange(taken, taken + len(out))
        yield got.assign(lane=np.int32(lane), position=position, batch=position // batch)

    lane = F.coalesce(F.col(END), F.pmod(F.xxhash64(*order), F.lit(lanes)).cast("int"))
    schema = StructType([*filled.fields, *StructType.fromDDL("lane int, position long, batch long").fields])
    fill = {flags[n]: F.col(n).isNull() for n in whole} | {n: F.coalesce(F.col(n), F.lit(0).cast(given[n].dataType)) for n in whole}
    dealt = rows.withColumn("lane", lane).withColumns(fill).groupBy("lane")
    out = dealt.applyInPandasWithState(update, schema, "buffer binary, taken long", "append", "NoTimeout")
    return out.select(*ADDED, *[F.when(~F.col(flags[n]), F.col(n)).alias(n) if n in flags else n for n in given.names])


def work_through(out: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Hand out what is there into a table and stop; called again with the same checkpoint it goes on. Gives all rows so far."""
    q = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(path)


def _own(df: DataFrame | StructType) -> None:
    names = df.columns if isinstance(df, DataFrame) else df.names
    if taken := {END, *ADDED} & set(names):
        raise ValueError(f"columns {', '.join(sorted(taken))} are taken")
