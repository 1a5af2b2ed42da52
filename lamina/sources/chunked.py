"""Chunked volumes as a data source: a folder in the public zarr v2 layout, read by boxes and written chunk by chunk.

`.zarray` holds shape, chunks, dtype, fill value and zlib as compressor, `.zattrs` the volume's attributes, `z/y/x` one chunk
each (edge chunks are full size, absent ones are the fill value). Filters on z, y and x choose the chunks that are opened.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from lamina.sources import store

AXES = ("z", "y", "x")
FORMAT = "chunked_volume"
READ_BYTES = 64 << 20  # voxels of about so many bytes are one partition


@dataclass(frozen=True)
class Grid:
    """Shape of a volume and of its chunks; a fourth axis, if any, is the first one and holds channels."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    fill: float

    def __post_init__(self):
        if len(self.shape) not in (3, 4) or len(self.chunks) != len(self.shape):
            raise ValueError(f"rank {len(self.shape)} with chunks of rank {len(self.chunks)}; 3 or 4 is needed")
        if min(self.chunks) < 1 or min(self.shape) < 0:
            raise ValueError(f"shape {self.shape} in chunks of {self.chunks}")

    @property
    def counts(self) -> tuple[int, ...]:
        return tuple(-(-n // c) for n, c in zip(self.shape[-3:], self.chunks[-3:]))

    def meta(self) -> bytes:
        fill = self.fill if np.dtype(self.dtype).kind == "f" else int(self.fill)
        return json.dumps({"zarr_format": 2, "shape": self.shape, "chunks": self.chunks, "dtype": np.dtype(self.dtype).str, "fill_value": fill, "order": "C", "filters": None, "compressor": {"id": "zlib", "level": 1}, "dimension_separator": "/"}).encode()

    @classmethod
    def of(cls, meta: dict) -> Grid:
        compressor = (meta["compressor"] or {}).get("id")
        if meta["zarr_format"] != 2 or meta["filters"] or meta["order"] != "C" or compressor not in (None, "zlib"):
            raise ValueError(f"format {meta['zarr_format']}, order {meta['order']}, filters {meta['filters']}, compressor {compressor}: not read")
        return cls(tuple(meta["shape"]), tuple(meta["chunks"]), meta["dtype"], meta["fill_value"] or 0)

    def packed(self, a: np.ndarray) -> bytes:
        return zlib.compress(np.ascontiguousarray(a, self.dtype).tobytes(), 1)

    def unpacked(self, data: bytes, raw: bool = False) -> np.ndarray:
        return np.frombuffer(data if raw else zlib.decompress(data), self.dtype).reshape(self.chunks)


def described(path: str) -> tuple[Grid, dict, dict]:
    """(grid, metadata, attributes) of a volume."""
    system, root = store.opened(path)
    found = store.get(system, f"{root}/.zarray")
    if found is None:
        raise FileNotFoundError(f"no finished volume at {path}")
    meta = json.loads(found)
    return Grid.of(meta), meta, json.loads(store.get(system, f"{root}/.zattrs") or b"{}")


def attributes(path: str) -> dict:
    return described(path)[2]


@dataclass
class Run(InputPartition):
    """Chunks of the chosen box from one number to another, x fastest."""

    start: int
    stop: int


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.channel = options["path"], int(options.get("channel", 0))
        self.missing, self.size = options.get("missing", "fill"), int(options.get("partitionBytes", READ_BYTES))
        if self.missing not in ("fill", "skip"):
            raise ValueError("missing chunks are either 'fill' or 'skip'")
        self.grid, meta, _ = described(self.path)
        self.raw, self.separator = not meta["compressor"], meta.get("dimension_separator", ".")
        if len(self.grid.shape) == 4 and not 0 <= self.channel < self.grid.shape[0]:
            raise ValueError(f"channel {self.channel} of {self.grid.shape[0]}")
        self.low, self.high = [0, 0, 0], list(self.grid.shape[-3:])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of z, y and x become the box; a list of values narrows it and is checked again by Spark, like all other filters."""
        for f in filters:
            axis = AXES.index(f.attribute[0]) if getattr(f, "attribute", None) in [(a,) for a in AXES] else None
            if axis is None:
                yield f
            elif isinstance(f, EqualTo):
                self._within(axis, f.value, f.value + 1)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self._within(axis, f.value + isinstance(f, GreaterThan), None)
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self._within(axis, None, f.value + isinstance(f, LessThanOrEqual))
            else:
                if isinstance(f, In) and (values := [v for v in f.value if v is not None]):
                    self._within(axis, min(values), max(values) + 1)
                yield f

    def _within(self, axis: int, low: int | None, high: int | None) -> None:
        if low is not None:
            self.low[axis] = max(self.low[axis], low)
        if high is not None:
            self.high[axis] = min(self.high[axis], high)

    def _box(self) -> tuple[list[int], list[int]]:
        """First chunk and number of chunks of each axis; no number is below 0."""
        first = [lo // c for lo, c in zip(self.low, self.grid.chunks[-3:])]
        return first, [max(-(-hi // c) - f, 0) if hi > lo else 0 for lo, hi, c, f in zip(self.low, self.high, self.grid.chunks[-3:], first)]

    def partitions(self) -> list[Run]:
        n = math.prod(self._box()[1])
        voxel = 12 + np.dtype(self.grid.dtype).itemsize
        step = max(1, self.size // (math.prod(self.grid.chunks[-3:]) * voxel))
        return [Run(k, min(n, k + step)) for k in range(0, n, step)] or [Run(0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        system, root = store.opened(self.path)
        g, (first, count) = self.grid, self._box()
        size = g.chunks[-3:]
        schema = pa.schema([(a, pa.int32()) for a in AXES] + [("value", pa.from_numpy_dtype(value_type(g.dtype)))])
        for k in range(partition.start, partition.stop):
            at = [f + i for f, i in zip(first, np.unravel_index(k, count))]
            key = ([self.channel // g.chunks[0]] if len(g.shape) == 4 else []) + at
            data = store.get(system, f"{root}/{self.separator.join(str(int(i)) for i in key)}")
            if data is None and self.missing == "skip":
                continue
            a = np.full(g.chunks, g.fill, g.dtype) if data is None else g.unpacked(data, self.raw)
            a = a[self.channel % g.chunks[0]] if a.ndim == 4 else a
            start = [int(i) * s for i, s in zip(at, size)]
            cut = tuple(slice(max(lo - o, 0), min(hi - o, s)) for lo, hi, o, s in zip(self.low, self.high, start, size))
            a = a[cut]
            where = [(np.arange(n, dtype=np.int32) + o + c.start) for n, o, c in zip(a.shape, start, cut)]
            z, y, x = np.broadcast_arrays(where[0][:, None, None], where[1][:, None], where[2])
            arrays = [pa.array(v.ravel()) for v in (z, y, x)] + [pa.array(a.ravel().astype(value_type(g.dtype)))]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def value_type(dtype: str) -> np.dtype:
    """What a column of Spark's holds them in: doubles for real numbers, longs for whole ones."""
    return np.dtype("float64" if np.dtype(dtype).kind == "f" else "int64")


@dataclass
class Written(WriterCommitMessage):
    chunks: int = 0
    counts: dict = field(default_factory=dict)


class ChunkWriter(DataSourceArrowWriter):
    """Rows come sorted by chunk (`write_volume` deals them): one chunk is held at a time and is whole once it has its name.

    An overwritten volume has no `.zarray` until all tasks are done, so that a part of it is never taken for it. Other
    writes replace the voxels that they give and keep the rest of their chunks. A task that runs again writes the same chunks.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.count = options.get("count", "false") == "true"
        self.attrs = json.loads(options.get("attributes", "{}"))
        if overwrite:
            numbers = lambda name: tuple(int(n) for n in options[name].split(","))
            self.grid = Grid(numbers("shape"), numbers("chunks"), options["dtype"], float(options.get("fill", 0)))
            if len(self.grid.shape) != 3:
                raise ValueError("volumes of rank 3 are written")
            system, root = store.opened(self.path)
            store.removed(system, root)
        else:
            if self.count:
                raise ValueError("values are counted when the whole volume is written")
            self.grid, meta, _ = described(self.path)
            if len(self.grid.shape) != 3 or not meta["compressor"] or meta.get("dimension_separator") != "/":
                raise ValueError("only volumes that were written here can be added to")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = store.opened(self.path)
        done, key, a, seen = Written(), None, None, set()
        counts: Counter = Counter()

        def close():
            if key is None:
                return
            store.put(system, f"{root}/{'/'.join(map(str, key))}", self.grid.packed(a))
            done.chunks += 1
            if self.count:
                inside = a[tuple(slice(0, min(c, n - k * c)) for k, c, n in zip(key, self.grid.chunks, self.grid.shape))]
                counts.update(dict(zip(*(v.tolist() for v in np.unique(inside, return_counts=True)))))
                counts[self.grid.fill] -= inside.size  # the rest of the volume is counted as fill

        for batch in iterator:
            if batch.num_rows == 0:
                continue
            at = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in AXES])
            value = batch.column("value").to_numpy(zero_copy_only=False)
            if (at < 0).any() or (at >= np.array(self.grid.shape)[:, None]).any():
                raise ValueError(f"voxels outside {self.grid.shape}")
            chunk = at // np.array(self.grid.chunks)[:, None]
            edges = np.flatnonzero(np.concatenate(([True], (np.diff(chunk) != 0).any(axis=0), [True])))
            for lo, hi in zip(edges[:-1], edges[1:]):
                own = tuple(int(c) for c in chunk[:, lo])
                if own != key:
                    close()
                    if own in seen:
                        raise ValueError("rows are not sorted by chunk")
                    seen.add(own)
                    key, a = own, self._old(system, root, own)
                a[tuple(at[:, lo:hi] - (np.array(key) * self.grid.chunks)[:, None])] = value[lo:hi]
        close()
        done.counts = dict(counts)
        return done

    def _old(self, system, root: str, key: tuple[int, ...]) -> np.ndarray:
        data = None if self.overwrite else store.get(system, f"{root}/{'/'.join(map(str, key))}")
        return np.full(self.grid.chunks, self.grid.fill, self.grid.dtype) if data is None else self.grid.unpacked(data).copy()

    def commit(self, messages: list[Written | None]) -> None:
        system, root = store.opened(self.path)
        attrs = self.attrs if self.overwrite else attributes(self.path) | self.attrs
        if self.count:
            counts = Counter({self.grid.fill: math.prod(self.grid.shape)})
            for m in filter(None, messages):
                counts.update(m.counts)
            whole = np.dtype(self.grid.dtype).kind != "f"
            attrs = attrs | {"partition_counts": {str(int(v) if whole else v): int(n) for v, n in sorted(counts.items()) if n}}
        store.put(system, f"{root}/.zattrs", json.dumps(attrs).encode())
        if self.overwrite:
            store.put(system, f"{root}/.zarray", self.grid.meta())

    def abort(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            system, root = store.opened(self.path)
            store.removed(system, root)


class ChunkedVolume(DataSource):
    """Options: path; to read: channel, missing (fill or skip), partitionBytes; to overwrite: shape, chunks, dtype, fill, attributes, count."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"z int, y int, x int, value {'double' if value_type(described(self.options['path'])[0].dtype).kind == 'f' else 'long'}"

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ChunkWriter(dict(self.options), overwrite)


def registered(spark: SparkSession) -> None:
    """Make the format known to a session; box reads need filters to reach Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkedVolume)


def read_volume(spark: SparkSession, path: str, channel: int = 0, missing: str = "fill") -> DataFrame:
    """(z, y, x, value); a filter on z, y, x opens only the chunks of its box. With missing='skip' absent chunks give no rows."""
    registered(spark)
    return spark.read.format(FORMAT).options(channel=channel, missing=missing).load(path)


def write_volume(
    vox: DataFrame, path: str, shape: tuple[int, int, int], chunks: tuple[int, int, int], dtype: str = "int64", value: str = "label", fill: float = 0, attrs: dict | None = None, count: bool = False
) -> None:
    """Write a new volume from its voxels; those that are not given have the fill value.

    `attrs` become attributes; with count, `partition_counts` (value: voxels, the fill value included) is added from what the tasks
    count as they write: for volumes of few values, such as partitions. Of rows of one voxel any may stay.
    """
    registered(vox.sparkSession)
    numbers = lambda t: ",".join(str(int(n)) for n in t)
    options = {"shape": numbers(shape), "chunks": numbers(chunks), "dtype": dtype, "fill": str(fill), "attributes": json.dumps(attrs or {}), "count": str(count).lower()}
    _dealt(vox, chunks, value).write.format(FORMAT).mode("overwrite").options(**options).save(path)


def add_to_volume(vox: DataFrame, path: str, value: str = "label", attrs: dict | None = None) -> None:
    """Replace voxels of a volume; the others keep their values. Two writers must not share a chunk."""
    registered(vox.sparkSession)
    _dealt(vox, described(path)[0].chunks, value).write.format(FORMAT).mode("append").option("attributes", json.dumps(attrs or {})).save(path)


def _dealt(vox: DataFrame, chunks: tuple[int, ...], value: str) -> DataFrame:
    corner = [F.floor(F.col(a) / c) for a, c in zip(AXES, chunks)]
    return vox.select(*[F.col(a).cast("int").alias(a) for a in AXES], F.col(value).alias("value")).repartition(*corner).sortWithinPartitions(*corner)
