"""Volume sources and sinks: voxel views, packed blocks, sub-volume folders and coordinate tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
BLOCK_SCHEMA = "volume string, cz int, cy int, cx int, nz int, ny int, nx int, dtype string, data binary"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels_of_vectors(vectors: DataFrame, rows_per_slice: int = 16) -> DataFrame:
    """Voxel view (z, y, x, value, label) of a table of vectors: each vector is a row of a slice; only full slices."""
    n = vectors.count()
    full = rows_per_slice * (n // rows_per_slice)
    rows = vectors.where(F.col("vec_id") < full).select(
        F.expr(f"CAST(vec_id DIV {rows_per_slice} AS INT)").alias("z"),
        (F.col("vec_id") % rows_per_slice).cast("int").alias("y"),
        "label",
        F.posexplode("embedding").alias("x", "v"),
    )
    value = F.col("v").cast("double")
    label = F.when(value > 0, F.col("label").cast("long") + 1).otherwise(F.lit(0).cast("long"))
    return rows.select("z", "y", "x", value.alias("value"), label.alias("label"))


def two_segmentations(lineitem: DataFrame) -> DataFrame:
    """Pairs of labels (a, b) per voxel of two aligned segmentations."""
    return lineitem.select((F.col("l_partkey") % 40).cast("long").alias("a"), (F.col("l_suppkey") % 15).cast("long").alias("b"))


def pack_blocks(vox: DataFrame, size: tuple[int, int, int], value: str = "label", dtype: str = "int64", volume: str = "v") -> DataFrame:
    """Dense blocks from a voxel view; one block is one row, absent voxels are 0."""
    bz, by, bx = size

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cz, cy, cx = (int(k) for k in key)
        out = np.zeros(size, dtype)
        out[rows["z"] - cz, rows["y"] - cy, rows["x"] - cx] = rows["value"]
        return pd.DataFrame([(volume, cz, cy, cx, bz, by, bx, dtype, out.tobytes())], columns=["volume", "cz", "cy", "cx", "nz", "ny", "nx", "dtype", "data"])

    corner = [(F.floor(F.col(a) / s) * s).cast("int").alias(f"c{a}") for a, s in zip(AXES, size)]
    rows = vox.select(*corner, *AXES, F.col(value).alias("value"))
    return rows.groupBy("cz", "cy", "cx").applyInPandas(pack, BLOCK_SCHEMA)


def unpack_blocks(blocks: DataFrame, value: str = "label", kind: str = "long") -> DataFrame:
    """Voxel view of packed blocks, without zeros."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                a = np.frombuffer(r.data, r.dtype).reshape(r.nz, r.ny, r.nx)
                z, y, x = np.nonzero(a)
                yield pd.DataFrame({"volume": r.volume, "z": (z + r.cz).astype(np.int32), "y": (y + r.cy).astype(np.int32), "x": (x + r.cx).astype(np.int32), value: a[z, y, x]})

    return blocks.mapInPandas(run, f"volume string, z int, y int, x int, {value} {kind}")


def with_halo(vox: DataFrame, size: tuple[int, int, int], halo: tuple[int, int, int]) -> DataFrame:
    """Deal each voxel to every block that needs it; is_core marks the block that owns it."""
    out = vox
    for a, s, h in zip(AXES, size, halo):
        own = F.floor(F.col(a) / s).cast("int")
        first, last = F.floor((F.col(a) - h) / s).cast("int"), F.floor((F.col(a) + h) / s).cast("int")
        out = out.withColumn(f"b{a}", F.explode(F.sequence(first, last))).withColumn(f"_own{a}", own)
    core = F.lit(True)
    for a in AXES:
        core = core & (F.col(f"b{a}") == F.col(f"_own{a}"))
    return out.withColumn("is_core", core).drop(*[f"_own{a}" for a in AXES])


def subvolume_path(x: Column, y: Column, z: Column, kind: str = "seg", suffix: str = "npz") -> Column:
    """Path of a sub-volume below its folder: x/y/<kind>-x_y_z.<suffix>."""
    return F.format_string(f"%d/%d/{kind}-%d_%d_%d.{suffix}", x, y, x, y, z)


def corner_of_path(path: Column) -> Column:
    """Corner (z, y, x) in a sub-volume's file name, null where there is none."""
    part = lambda k: F.nullif(F.regexp_extract(path, r"(\d+)_(\d+)_(\d+)\.npz$", k), F.lit("")).cast("int")
    return F.struct(part(3).alias("z"), part(2).alias("y"), part(1).alias("x"))


def expand_shards(pattern: str) -> list[str]:
    """Comma-separated paths; `name@3` stands for name-00000-of-00003 to name-00002-of-00003."""
    out = []
    for part in filter(None, (p.strip() for p in pattern.split(","))):
        m = re.fullmatch(r"(.*)@(\d+)", part)
        out += [f"{m[1]}-{i:05d}-of-{int(m[2]):05d}" for i in range(int(m[2]))] if m else [part]
    return out


def read_coordinates(spark: SparkSession, pattern: str) -> DataFrame:
    """Coordinate tables with the defaults of their optional columns."""
    rows = spark.read.parquet(*expand_shards(pattern))
    have = set(rows.columns)
    col = lambda n, kind, default: (F.coalesce(F.col(n), F.lit(default)) if n in have else F.lit(default)).cast(kind).alias(n)
    return rows.select("volume", *AXES, *([F.col("label")] if "label" in have else []), col("segment_id", "long", 0), col("radius", "float", 0.0))


def write_coordinates(coords: DataFrame, path: str) -> None:
    coords.write.mode("overwrite").option("compression", "gzip").parquet(path)


def save_subvolumes(vox: DataFrame, size: tuple[int, int, int], path: str, value: str = "label") -> None:
    """Write the positive labels, a folder per corner; the committer makes it atomic."""
    corner = [(F.floor(F.col(a) / s) * s).cast("int").alias(f"c{a}") for a, s in zip(AXES, size)]
    rows = vox.where(F.col(value) > 0).select(*corner, *AXES, value)
    rows.repartition(*[f"c{a}" for a in AXES]).write.mode("overwrite").partitionBy("cz", "cy", "cx").parquet(path)


def load_subvolume(spark: SparkSession, path: str, corner: tuple[int, int, int]) -> DataFrame:
    """One corner; only its folder is read."""
    cz, cy, cx = corner
    return spark.read.parquet(path).where(f"cz = {cz} AND cy = {cy} AND cx = {cx}").drop("cz", "cy", "cx")


def existing_corners(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("cz", "cy", "cx").distinct()


def volume_map(specs: str) -> dict[str, str]:
    """`name:path` or `name:path:dataset` items, comma-separated."""
    return dict(item.split(":", 1) for item in specs.split(",") if item)


def registered_npy(spark: SparkSession) -> None:
    """Register a data source `npy_volume` that yields (z, y, x, value), a partition per slab of slices."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Slab(InputPartition):
        def __init__(self, start: int, stop: int):
            self.start, self.stop = start, stop

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.path, self.key, self.depth = options["path"], options.get("dataset"), int(options.get("slices", 16))

        def _open(self) -> np.ndarray:
            got = np.load(self.path, mmap_mode="r", allow_pickle=False)
            a = got[self.key] if self.key else got
            if a.ndim not in (3, 4):
                raise ValueError(f"rank {a.ndim}; 3 or 4 is needed")
            return a if a.ndim == 3 else a[0]

        def partitions(self) -> list:
            n = self._open().shape[0]
            return [Slab(k, min(n, k + self.depth)) for k in range(0, n, self.depth)]

        def read(self, partition: Slab):
            a = self._open()[partition.start : partition.stop]
            for (z, y, x), v in np.ndenumerate(a):
                yield (z + partition.start, y, x, float(v))

    class Npy(DataSource):
        @classmethod
        def name(cls) -> str:
            return "npy_volume"

        def schema(self) -> str:
            return "z int, y int, x int, value double"

        def reader(self, schema) -> DataSourceReader:
            return Reader(dict(self.options))

    spark.dataSource.register(Npy)
