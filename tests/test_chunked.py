"""Chunked volumes: round trips, boxes that open only their chunks, additions, counts, writes that fail."""

import json
import os
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamina.sources import chunked


def rows_of(a, keep=None):
    at = np.indices(a.shape).reshape(3, -1).astype(np.int32)
    df = pd.DataFrame({"z": at[0], "y": at[1], "x": at[2], "label": a.ravel()})
    return df if keep is None else df[keep.ravel()]


def array_of(df, shape, fill=0):
    out = np.full(shape, fill, float)
    got = df.toPandas()
    out[got["z"], got["y"], got["x"]] = got["value"]
    return out, len(got)


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/vol"


def files(path):
    root = path.removeprefix("file://")
    return {os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs}


@pytest.mark.parametrize("dtype", ["int64", "uint8", "float32"])
def test_round_trip_with_edges(spark, path, dtype):
    a = np.random.default_rng(1).integers(0, 200, (7, 10, 13)).astype(dtype)
    chunked.write_volume(spark.createDataFrame(rows_of(a)), path, a.shape, (3, 4, 5), dtype, attrs={"by": "test"})
    got, n = array_of(chunked.read_volume(spark, path), a.shape)
    assert n == a.size and (got == a).all()
    assert chunked.attributes(path) == {"by": "test"}
    # nothing but named chunks and the two descriptions is left, and a chunk is a full one in zlib
    assert files(path) == {".zarray", ".zattrs"} | {f"{z}/{y}/{x}" for z in range(3) for y in range(3) for x in range(3)}
    with open(path.removeprefix("file://") + "/2/2/2", "rb") as f:
        last = np.frombuffer(zlib.decompress(f.read()), dtype).reshape(3, 4, 5)
    assert (last[:1, :2, :3] == a[6:, 8:, 10:]).all() and not last[1:].any()


def test_only_chunks_of_the_box_are_opened(spark, path):
    a = np.arange(8 * 8 * 8).reshape(8, 8, 8)
    chunked.write_volume(spark.createDataFrame(rows_of(a)), path, a.shape, (2, 2, 2))
    for z, y, x in np.ndindex(4, 4, 4):  # all chunks that the box does not touch are damaged
        if not (z in (1, 2) and y == 0 and x in (2, 3)):
            with open(f"{path.removeprefix('file://')}/{z}/{y}/{x}", "wb") as f:
                f.write(b"damaged")
    box = chunked.read_volume(spark, path).where("z > 2 AND z <= 4 AND y = 1 AND x BETWEEN 5 AND 6 AND value % 2 = 1")
    want = [(z, y, x, int(a[z, y, x])) for z, y, x in np.ndindex(a.shape) if 2 < z <= 4 and y == 1 and 5 <= x <= 6 and a[z, y, x] % 2]
    assert sorted(map(tuple, box.collect())) == want
    few = chunked.read_volume(spark, path).where(F.col("z").isin(2, 5) & (F.col("y") == 0) & (F.col("x") >= 4))
    assert sorted({(r["z"], r["x"]) for r in few.collect()}) == [(z, x) for z in (2, 5) for x in range(4, 8)]
    assert chunked.read_volume(spark, path).where("z > 100").count() == 0
    assert chunked.read_volume(spark, path).where("z > 4 AND z < 3").count() == 0
    with pytest.raises(Exception, match="zlib|header"):
        chunked.read_volume(spark, path).count()


def test_partitions_are_runs_of_chunks(spark, path):
    a = np.ones((8, 8, 8), np.int64)
    chunked.write_volume(spark.createDataFrame(rows_of(a)), path, a.shape, (2, 2, 2))
    reader = chunked.ChunkReader({"path": path, "partitionBytes": str(8 * 20 * 10)})
    assert [(p.start, p.stop) for p in reader.partitions()] == [(k, min(k + 10, 64)) for k in range(0, 64, 10)]
    assert list(reader.pushFilters([chunked.EqualTo(("z",), 3), chunked.EqualTo(("value",), 1)])) == [chunked.EqualTo(("value",), 1)]
    assert sum(p.stop - p.start for p in reader.partitions()) == 16


def test_fill_counts_and_absent_chunks(spark, path):
    rng = np.random.default_rng(3)
    a, keep = rng.integers(0, 4, (6, 6, 6)), rng.random((6, 6, 6)) < 0.4
    keep[:3, :3] = False
    chunked.write_volume(spark.createDataFrame(rows_of(a, keep)), path, a.shape, (3, 3, 4), "uint8", fill=255, count=True, attrs={"bounding_boxes": [[[0, 0, 0], [6, 6, 6]]]})
    want = np.where(keep, a, 255)
    got, n = array_of(chunked.read_volume(spark, path), a.shape)
    assert n == a.size and (got == want).all()
    values, counts = np.unique(want, return_counts=True)
    assert chunked.attributes(path) == {"bounding_boxes": [[[0, 0, 0], [6, 6, 6]]], "partition_counts": {str(v): int(c) for v, c in zip(values, counts)}}
    assert "0/0/0" not in files(path)
    got, n = array_of(chunked.read_volume(spark, path, missing="skip"), a.shape, 255)
    assert n == a.size - 54 and (got == want).all()


def test_additions_keep_the_rest(spark, path):
    a = np.arange(216).reshape(6, 6, 6)
    chunked.write_volume(spark.createDataFrame(rows_of(a)), path, a.shape, (4, 4, 4), attrs={"a": 1})
    part = spark.createDataFrame(rows_of(a)).where("z = 3 AND x > 2").withColumn("label", -F.col("label"))
    for _ in range(2):  # a write that runs again changes nothing
        chunked.add_to_volume(part, path, attrs={"b": 2})
    a[3, :, 3:] *= -1
    assert (array_of(chunked.read_volume(spark, path), a.shape)[0] == a).all()
    assert chunked.attributes(path) == {"a": 1, "b": 2}


def test_failed_and_empty_writes(spark, path):
    a = np.ones((4, 4, 4), np.int64)
    with pytest.raises(Exception, match="voxels outside"):
        chunked.write_volume(spark.createDataFrame(rows_of(a)), path, (4, 4, 3), (2, 2, 2))
    with pytest.raises(Exception, match="no finished volume"):
        chunked.read_volume(spark, path).count()
    none = spark.createDataFrame(rows_of(a)).limit(0)
    chunked.write_volume(none, path, (2, 3, 4), (2, 2, 2), fill=9)
    assert {r["value"] for r in chunked.read_volume(spark, path).collect()} == {9}
    chunked.write_volume(none, path, (0, 3, 4), (2, 2, 2))
    assert chunked.read_volume(spark, path).count() == 0
    with pytest.raises(ValueError, match="rank 2"):
        chunked.Grid((4, 4), (2, 2), "uint8", 0)


def test_channels_and_foreign_layouts(spark, path):
    """Rank 4, dots between the numbers of a chunk, no compression: as other writers of the format leave it."""
    root = path.removeprefix("file://")
    os.makedirs(root)
    a = np.random.default_rng(5).random((3, 4, 4, 4)).astype("<f4")
    meta = {"zarr_format": 2, "shape": a.shape, "chunks": [2, 4, 4, 2], "dtype": "<f4", "fill_value": None, "order": "C", "filters": None, "compressor": None}
    with open(f"{root}/.zarray", "w") as f:
        json.dump(meta, f)
    for c in range(2):
        for x in range(2):
            chunk = np.zeros((2, 4, 4, 2), "<f4")
            cut = a[2 * c : 2 * c + 2, :, :, 2 * x : 2 * x + 2]
            chunk[: len(cut)] = cut
            chunk.tofile(f"{root}/{c}.0.0.{x}")
    for c in range(3):
        got, _ = array_of(chunked.read_volume(spark, path, channel=c), a.shape[1:])
        assert (got == a[c]).all()
    with pytest.raises(Exception, match="channel 3 of 3"):
        chunked.read_volume(spark, path, channel=3).count()
