"""Seed policies: tables of (ord, z, y, x). Policies are found by name, can be chained, reversed and resumed."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.operators import kernels, lines, spacing
from lamina.operators.shared import number
from lamina.operators.window import erode

AXES = ("z", "y", "x")
#: Offsets of the grid policies, in their order (fixed values).
GRID_3D = (0, 8, 4, 12, 2, 10, 14)
GRID_2D = (0, 8, 4, 12, 2, 6, 10, 14)
GRID_STEP = 16
#: Edge lengths (z, y, x) of the tiles in which volumes are dealt: a task holds a row of them.
TILE = (32, 32, 32)


def numbered(df: DataFrame, *order) -> DataFrame:
    """Seeds in order: ord counts from 1."""
    return number(df, "ord", *order).select("ord", *AXES)


def grid(spark: SparkSession, shape: tuple[int, int, int], three_d: bool, step: int = GRID_STEP, offsets: tuple | None = None) -> DataFrame:
    """Grid points offset by offset: of all axes, or of y and x on every slice."""
    offsets = offsets or (GRID_3D if three_d else GRID_2D)
    rows = spark.range(1).select(F.posexplode(F.array(*[F.lit(o) for o in offsets])).alias("_k", "_o"))
    for a, n in zip(AXES, shape):
        start = F.col("_o") if three_d or a != "z" else F.lit(0)
        every = step if three_d or a != "z" else 1
        rows = rows.where(start < n).withColumn(a, F.explode(F.sequence(start, F.lit(n - 1), F.lit(every))))
    return numbered(rows, "_k", *AXES)


def by_intensity(vox: DataFrame) -> DataFrame:
    return numbered(vox, F.desc("value"), F.desc("z"), F.desc("y"), F.desc("x"))


def of_origins(origins: DataFrame) -> DataFrame:
    """Start points of an earlier run, the highest id first."""
    return numbered(origins, F.desc("segment_id"))


def dense(vox: DataFrame, threshold: float, invert: bool = False, erosions: int = 0) -> DataFrame:
    hit = F.col("value") > threshold
    out = erode(vox.withColumn("_hit", ~hit if invert else hit), "_hit", erosions)
    return numbered(out.where("eroded"), *AXES)


def reverse(seeds: DataFrame) -> DataFrame:
    return numbered(seeds.withColumnRenamed("ord", "_ord"), F.desc("_ord"))


def chain(*seeds: DataFrame) -> DataFrame:
    parts = [s.withColumn("_policy", F.lit(k)).withColumnRenamed("ord", "_ord") for k, s in enumerate(seeds)]
    return numbered(reduce(DataFrame.unionByName, parts), "_policy", "_ord")


def resume(seeds: DataFrame, done: int) -> DataFrame:
    return seeds.where(F.col("ord") > done)


def inside(seeds: DataFrame, shape: tuple[int, int, int], margin: tuple[int, int, int]) -> DataFrame:
    return reduce(lambda d, k: d.where((F.col(k[0]) - k[2] >= 0) & (F.col(k[0]) + k[2] < k[1])), zip(AXES, shape, margin), seeds)


def _volumes(vox: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(volume, z, y, x, value, label, excluded): sub-volumes named by the keys are volumes of their own; without keys all voxels are one."""
    name = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]) if keys else F.lit("")
    more = {c: F.col(c) if c in vox.columns else F.lit(None) for c in ("value", "label")}
    off = F.coalesce(F.col("excluded"), F.lit(False)) if "excluded" in vox.columns else F.lit(False)
    return vox.select(name.alias("volume"), *AXES, more["value"].cast("double").alias("value"), more["label"].cast("long").alias("label"), off.alias("excluded"))


def _noise(at: list[Column], seed: int) -> Column:
    """Up to 1e-4 from the coordinates and the seed, so that it does not depend on how a volume is dealt."""
    return F.pmod(F.xxhash64(F.lit(seed), *at), F.lit(1 << 40)) / float(1 << 40) * 1e-4


def _maxima(packed: DataFrame, tile: tuple[int, int, int], axes: tuple[str, ...], reach: int, least: float, noise: int | None) -> DataFrame:
    """Voxels whose `value` is the largest within the reach along the axes and above `least`."""
    kinds = {"value": "f8"}
    if noise is not None:
        # the noise is added to unpacked voxels, then they are packed again
        v = lines.voxels(packed, tile, kinds, lambda a: np.isfinite(a["value"]), {"value": "double"})
        packed = lines.tiles(v, {"value": (F.col("value") + _noise([F.col(a) for a in AXES], noise), "f8", -np.inf)}, tile)
    out = {"value": "f8", "top": "f8"}
    for axis in axes:
        packed, kinds = lines.along(packed, axis, tile, kinds, lambda a: {"value": a["value"], "top": kernels.running_max(a.get("top", a["value"]), reach)}, out), out
    return lines.voxels(packed, tile, out, lambda a: (a["value"] == a["top"]) & (a["value"] > least), {"value": "double"})


def _spaced(found: DataFrame, axes: tuple[str, ...], reach: int, tile: tuple[int, int, int]) -> DataFrame:
    return spacing.spaced(found, tuple(reach if a in axes else 0 for a in AXES), ("volume",), tuple(max(4 * t, 4 * reach) for t in tile))


def _edge_distance(vox: DataFrame, axes: tuple[str, ...], sigma: float, tile: tuple[int, int, int]) -> DataFrame:
    """Packed tiles with `value`: how far each voxel is from the edges in the image, -1 where excluded or where there is no edge.

    Edges are where the gradient is above its own average under a Gaussian. Every step runs along whole lines:
    differences and smoothing of the gradient, the Gaussian, then the distance.
    """
    weights = kernels.gaussian_weights(sigma)
    packed = lines.tiles(vox, {"s": (F.col("value"), "f8", 0.0), "off": (F.col("excluded"), "?", True)}, tile)
    kinds = {"s": "f8", "off": "?"}
    line = lambda a, w: kernels.along(a, np.array(w, float), a.ndim - 1)
    for k, axis in enumerate(axes):
        last = k == len(axes) - 1

        def gradient(a: dict, axis: str = axis, last: bool = last) -> dict:
            got = {n: line(x, (1, 2, 1)) for n, x in a.items() if n != "off"} | {f"g{axis}": line(a["s"], (-1, 0, 1)), "off": a["off"]}
            if not last:
                return got
            edge = np.sqrt(sum(got[f"g{b}"] ** 2 for b in axes))
            return {"edge": edge, "mean": line(edge, weights), "off": a["off"]}

        out = {"edge": "f8", "mean": "f8", "off": "?"} if last else {"s": "f8", **{f"g{b}": "f8" for b in axes[: k + 1]}, "off": "?"}
        packed, kinds = lines.along(packed, axis, tile, kinds, gradient, out), out
    back = axes[::-1][1:]
    for axis in back[:-1]:
        packed = lines.along(packed, axis, tile, kinds, lambda a: a | {"mean": line(a["mean"], weights)}, kinds)
    near, out = {"d": "f8", "off": "?"}, {"d": "f8", "off": "?"}

    def first(a: dict) -> dict:
        edge = a["edge"] > line(a["mean"], weights)
        d = np.where(edge | a["off"], 0.0, np.inf)
        return {"d": kernels.envelope(d, np.zeros(d.shape, np.int8), 1.0)[0], "off": a["off"]}

    packed = lines.along(packed, axes[0], tile, kinds, first, out)
    for axis in axes[1:]:

        def go_on(a: dict, last: bool = axis == axes[-1]) -> dict:
            d = kernels.envelope(a["d"], np.zeros(a["d"].shape, np.int8), 1.0)[0]
            return {"value": np.where(a["off"] | ~np.isfinite(d), -1.0, np.sqrt(d))} if last else {"d": d, "off": a["off"]}

        packed = lines.along(packed, axis, tile, near, go_on, {"value": "f8"} if axis == axes[-1] else out)
    return packed


def peaks(vox: DataFrame, keys: tuple[str, ...] = (), min_distance: int = 3, sigma: float = 49 / 6, noise: int | None = None, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """Centres of areas away from edges: gradient, local threshold, distance transform, peaks; in raster order. The same for any tile."""
    packed = _edge_distance(_volumes(vox, keys), ("x", "y", "z"), sigma, tile)
    return numbered(_spaced(_maxima(packed, tile, ("z", "y", "x"), min_distance, 0.0, noise), AXES, min_distance, tile), *AXES, "volume")


def peaks_2d(vox: DataFrame, min_distance: int = 7, least: float = 2.5, sigma: float = 49 / 6, noise: int | None = None, tile: tuple[int, int, int] = TILE, keys: tuple[str, ...] = ()) -> DataFrame:
    """The same in each slice by itself."""
    packed = _edge_distance(_volumes(vox, keys), ("x", "y"), sigma, tile)
    return numbered(_spaced(_maxima(packed, tile, ("y", "x"), min_distance, least, noise), ("y", "x"), min_distance, tile), *AXES, "volume")


def fill_empty(vox: DataFrame, keys: tuple[str, ...] = (), min_distance: int = 2, least: float = 0.5, noise: int | None = None, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """Peaks of the distance to segments, in space without labels."""
    v = _volumes(vox, keys)
    packed = lines.tiles(v, {"d": (F.when((F.col("label") != 0) | F.col("excluded"), 0.0).otherwise(float("inf")), "f8", 0.0)}, tile)
    for axis in ("x", "y", "z"):
        packed = lines.along(packed, axis, tile, {"d": "f8"}, lambda a: {"d": kernels.envelope(a["d"], np.zeros(a["d"].shape, np.int8), 1.0)[0]}, {"d": "f8"})
    packed = lines.along(packed, "z", tile, {"d": "f8"}, lambda a: {"value": np.where(np.isfinite(a["d"]), np.sqrt(a["d"]), 0)}, {"value": "f8"})
    return numbered(_spaced(_maxima(packed, tile, ("z", "y", "x"), min_distance, least, noise), AXES, min_distance, tile), *AXES, "volume")


def _brightest(vox: DataFrame, keys: tuple[str, ...], axes: tuple[str, ...], min_distance: int, least: float, tile: tuple[int, int, int]) -> DataFrame:
    packed = lines.tiles(_volumes(vox, keys), {"value": (F.when(F.col("excluded"), float("-inf")).otherwise(F.col("value")), "f8", -np.inf)}, tile)
    return _spaced(_maxima(packed, tile, axes, min_distance, least, None), axes, min_distance, tile)


def intensity_peaks(vox: DataFrame, keys: tuple[str, ...] = (), min_distance: int = 3, least: float = 0.0, rel: float | None = None, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """Voxels that are the brightest of the box around them, above `least` and, with `rel`, above that share of the largest value of all."""
    floor = least if rel is None else max(least, rel * max(0.0, vox.agg(F.max("value")).first()[0] or 0.0))
    return numbered(_brightest(vox, keys, ("z", "y", "x"), min_distance, floor, tile), *AXES, "volume")


def peaks_2d_disk(vox: DataFrame, radius: int = 3, rel: float = 0.0) -> DataFrame:
    """Per slice, voxels that are the brightest of the disk around them, above a share of the slice's largest value and away from its border."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        low = rows[["y", "x"]].min().to_numpy()
        at = tuple((rows[a] - o).to_numpy() for a, o in zip(("y", "x"), low))
        shape = tuple(int(c.max()) + 1 for c in at)
        value, off = np.zeros(shape), np.ones(shape, bool)
        value[at], off[at] = rows["value"], rows["excluded"]
        found = kernels.disk_peaks(np.where(off, -np.inf, value), radius, rel * float(value.max())) + low
        return pd.DataFrame({"z": rows["z"].iloc[0], "y": found[:, 0], "x": found[:, 1]}).astype("int32")

    return numbered(_volumes(vox, ()).groupBy("z").applyInPandas(run, "z int, y int, x int"), *AXES)


def peaks_3d_2d(vox: DataFrame, keys: tuple[str, ...] = (), distance_3d: int = 4, distance_2d: int = 2, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """Peaks in space, then peaks of each slice; a negative distance leaves a phase out."""
    phases = []
    if distance_3d >= 0:
        phases.append(intensity_peaks(vox, keys, distance_3d, tile=tile))
    if distance_2d >= 0:
        phases.append(numbered(_brightest(vox, keys, ("y", "x"), distance_2d, 0.0, tile), *AXES, "volume"))
    return chain(*phases)


def brightest(vox: DataFrame, n: int, reach: tuple[int, int, int]) -> DataFrame:
    """The n first of: the brightest voxel (ties: raster order), then the brightest outside the boxes of +-reach around those before. k counts from 1."""
    order = Window.orderBy(F.desc("value"), *AXES)
    first = spacing.spaced(vox.select(*AXES, "value"), reach).orderBy(F.desc("value"), *AXES).limit(n)  # n rows
    return first.withColumn("k", F.row_number().over(order))


POLICIES: dict[str, Callable] = {f.__name__: f for f in (grid, by_intensity, of_origins, dense, peaks, peaks_2d, fill_empty, intensity_peaks, peaks_2d_disk, peaks_3d_2d)}


def policy(name: str) -> Callable:
    if name not in POLICIES:
        raise KeyError(f"unknown seed policy {name!r}; known: {', '.join(sorted(POLICIES))}")
    return POLICIES[name]
