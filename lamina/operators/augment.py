"""Augmentations of patches given as voxel rows; draws come from hashes of the example, so they can be repeated."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import kernels

AXES = ("z", "y", "x")


def reflect(vox: DataFrame, shape: tuple[int, int, int], axes: tuple[bool, bool, bool]) -> DataFrame:
    return vox.withColumns({a: F.lit(n - 1) - F.col(a) for a, n, on in zip(AXES, shape, axes) if on})


def permute(vox: DataFrame, order: tuple[str, str, str]) -> DataFrame:
    """New z, y, x are the given old axes."""
    return vox.withColumnsRenamed({a: f"_{a}" for a in AXES}).withColumns({a: F.col(f"_{o}") for a, o in zip(AXES, order)}).drop(*[f"_{a}" for a in AXES])


def transpose_xy(vox: DataFrame) -> DataFrame:
    return permute(vox, ("z", "x", "y"))


def draw(seed: int, *cols: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def misalign(vox: DataFrame, z0: int, dy: int, dx: int, shape: tuple[int, int, int], slip: bool) -> DataFrame:
    """Shift one slice (slip) or all from it on, wrapping."""
    on = (F.col("z") == z0) if slip else (F.col("z") >= z0)
    move = lambda c, d, n: F.when(on, F.pmod(F.col(c) + d, F.lit(n))).otherwise(F.col(c))
    return vox.withColumns({"y": move("y", dy, shape[1]), "x": move("x", dx, shape[2])})


def some_slices(vox: DataFrame, ratio: float, seed: int, *keys: str) -> DataFrame:
    """`chosen`: between 1 and a share of the slices, without replacement."""
    z = vox.select(*keys, "z").distinct()
    order = Window.partitionBy(*keys).orderBy(draw(seed, *keys, "z"), "z")
    n = F.count("*").over(Window.partitionBy(*keys))
    most = F.greatest(F.floor(n * ratio), F.lit(1))
    k = 1 + F.floor(draw(seed + 1, *keys) * most) if keys else 1 + F.floor(draw(seed + 1) * most)
    z = z.withColumn("chosen", F.row_number().over(order) <= k)
    return vox.join(z, [*keys, "z"])


def missing(v: Column, chosen: Column, quadrant: tuple[int, int, int, int] | None, fill: float) -> Column:
    """Fill chosen slices, whole or in (y0, y1, x0, x1)."""
    hit = chosen
    if quadrant:
        y0, y1, x0, x1 = quadrant
        hit = hit & (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)
    return F.when(hit, F.lit(fill)).otherwise(v)


def grayscale(v: Column, contrast: Column | float, brightness: Column | float, gamma: Column | float, most: float = 255.0) -> Column:
    return F.pow(F.least(F.greatest(v / most * contrast + brightness, F.lit(0.0)), F.lit(1.0)), gamma) * most


def contrast_brightness(vox: DataFrame, contrast: float, brightness: float, apply_to: str, *keys: str) -> DataFrame:
    """(v - mean) * contrast + mean + brightness, for all voxels, the foreground or the background."""
    mean = F.avg("value").over(Window.partitionBy(*keys))
    new = (F.col("value") - mean) * contrast + mean + brightness
    on = {"all": F.lit(True), "foreground": F.col("label") > 0, "background": F.col("label") <= 0}[apply_to]
    return vox.withColumn("value", F.when(on, new).otherwise(F.col("value")))


def rotation(u: tuple[float, float, float]) -> np.ndarray:
    """Uniform random rotation of space from three uniforms, through a unit quaternion."""
    a, b = np.sqrt(1 - u[0]), np.sqrt(u[0])
    s, t = 2 * np.pi * u[1], 2 * np.pi * u[2]
    w, x, y, z = b * np.cos(t), a * np.sin(s), a * np.cos(s), b * np.sin(t)
    return np.array(
        [
            [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
            [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
            [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
        ]
    )


def rotated_input_size(size: tuple[int, ...], in_voxel: tuple[float, ...], out_voxel: tuple[float, ...]) -> tuple[int, ...]:
    extent = max(n * v for n, v in zip(size, out_voxel)) * np.sqrt(2)
    return tuple(int(np.ceil(extent / v)) for v in in_voxel)


def rotate(vox: DataFrame, matrix: np.ndarray, in_shape: tuple[int, int, int], out_shape: tuple[int, int, int], fill: float = 0.0) -> DataFrame:
    """Nearest-voxel rotation about the centres: each output voxel looks up its source by a join on coordinates."""
    spark, n = vox.sparkSession, out_shape[0] * out_shape[1] * out_shape[2]
    grid = spark.range(n).select(
        F.floor(F.col("id") / (out_shape[1] * out_shape[2])).cast("int").alias("z"),
        F.pmod(F.floor(F.col("id") / out_shape[2]), F.lit(out_shape[1])).cast("int").alias("y"),
        F.pmod("id", F.lit(out_shape[2])).cast("int").alias("x"),
    )
    cols = {}
    for r, (a, ni) in enumerate(zip(AXES, in_shape)):
        at = reduce(lambda p, q: p + q, [F.lit(float(matrix[c, r])) * (F.col(b) - (no - 1) / 2) for c, (b, no) in enumerate(zip(AXES, out_shape))])
        cols[f"_s{a}"] = F.floor(at + (ni - 1) / 2 + 0.5).cast("int")
    src = vox.withColumnsRenamed({a: f"_s{a}" for a in AXES})
    return grid.withColumns(cols).join(src, [f"_s{a}" for a in AXES], "left").select(*AXES, F.coalesce("value", F.lit(fill)).alias("value"))


def _sampled(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at places, clamped at the border."""
    y, x = np.clip(y, 0, a.shape[0] - 1), np.clip(x, 0, a.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), max(a.shape[0] - 2, 0)), np.minimum(x.astype(int), max(a.shape[1] - 2, 0))
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = y - y0, x - x0
    return (1 - fy) * ((1 - fx) * a[y0, x0] + fx * a[y0, x1]) + fy * ((1 - fx) * a[y1, x0] + fx * a[y1, x1])


def warp_slices(vox: DataFrame, kind: str, seed: int, strength: float, *keys: str) -> DataFrame:
    """Per slice: 'elastic' (smooth random field), 'affine' (rotation, scale, shear) or 'focus' (blur), by strength."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        low = rows[["y", "x"]].min().to_numpy()
        at = ((rows["y"] - low[0]).to_numpy(), (rows["x"] - low[1]).to_numpy())
        a = np.zeros(tuple(int(c.max()) + 1 for c in at))
        a[at] = rows["value"]
        r = np.random.default_rng([seed, int(rows["z"].iloc[0])])
        if kind == "focus":
            new = kernels.gaussian(a, max(strength * r.random(), 1e-3))
        else:
            y, x = np.indices(a.shape).astype(float)
            if kind == "elastic":
                dy, dx = (kernels.gaussian(r.standard_normal(a.shape), max(min(a.shape) / 8, 0.5)) for _ in range(2))
                scale = strength / max(np.abs(dy).max(), np.abs(dx).max(), 1e-9)
                y, x = y + dy * scale, x + dx * scale
            else:
                t, s, h = (r.random(3) * 2 - 1) * strength
                cy, cx = (n / 2 for n in a.shape)
                m = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]]) @ np.array([[1 + s, h], [0, 1 + s]])
                y, x = m[0, 0] * (y - cy) + m[0, 1] * (x - cx) + cy, m[1, 0] * (y - cy) + m[1, 1] * (x - cx) + cx
            new = _sampled(a, y, x)
        return rows.assign(value=new[at])

    return vox.groupBy(*keys, "z").applyInPandas(run, vox.schema)


def applied(vox: DataFrame, skip: float, seed: int, keys: list[str], change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An augmentation that a share of the examples (keys) skips; one draw an example."""
    drawn = draw(seed, *keys)
    if skip <= 0:
        return change(vox)
    if not keys:
        raise ValueError("a share to skip needs keys that tell examples apart")
    return vox.where(drawn < skip).select(vox.columns).unionByName(change(vox.where(drawn >= skip)).select(vox.columns))


def section_augmentations(
    vox: DataFrame, shape: tuple[int, int, int], keys: list[str], seed: int, elastic: dict | None = None, affine: dict | None = None, misaligned: dict | None = None, lost: dict | None = None, focus: dict | None = None, gray: dict | None = None
) -> DataFrame:
    """Section changes in their fixed order: elastic, affine, misalignment, missing sections, focus, grayscale; what is None is left out.

    Each may have `skip`, the share of examples without it. elastic, affine, focus: `strength`. misaligned: z, dy, dx, slip. lost: `ratio`
    of the slices, `fill`, `quadrant`. gray: contrast, brightness, gamma, most.
    """
    out, plain = vox, vox.columns
    for k, (kind, args) in enumerate((("elastic", elastic), ("affine", affine), ("misaligned", misaligned), ("lost", lost), ("focus", focus), ("gray", gray))):
        if args is None:
            continue
        a = {n: v for n, v in args.items() if n != "skip"}

        def change(d: DataFrame, kind: str = kind, a: dict = a, own: int = seed + 17 * k) -> DataFrame:
            if kind in ("elastic", "affine", "focus"):
                return warp_slices(d, kind, own, a["strength"], *keys)
            if kind == "misaligned":
                return misalign(d, a["z"], a["dy"], a["dx"], shape, a.get("slip", False)).withColumns({c: F.col(c).cast("int") for c in ("y", "x")})
            if kind == "lost":
                hit = some_slices(d, a["ratio"], own, *keys)
                return hit.withColumn("value", missing(F.col("value"), F.col("chosen"), a.get("quadrant"), a.get("fill", 0.0)))
            return d.withColumn("value", grayscale(F.col("value"), a.get("contrast", 1.0), a.get("brightness", 0.0), a.get("gamma", 1.0), a.get("most", 255.0)))

        out = applied(out, args.get("skip", 0.0), seed + 31 * k + 5, keys, change).select(*plain)
    return out


def apply_augmentation(vox: DataFrame, shape: tuple[int, int, int], keys: list[str], seed: int, sections: dict | None = None, reflected: tuple[bool, bool, bool] | None = None, order: tuple[str, str, str] | None = None, matrix: np.ndarray | None = None) -> DataFrame:
    """Section changes, then reflection and permutation of the axes, then a rotation (values only), each if given; labels go along through all but the rotation.

    A rotation needs one example: the frame of a single patch.
    """
    out = section_augmentations(vox, shape, keys, seed, **sections) if sections else vox
    if reflected:
        out = reflect(out, shape, reflected).withColumns({a: F.col(a).cast("int") for a in AXES})
    if order:
        out = permute(out, order)
        shape = tuple(shape[AXES.index(o)] for o in order)
    if matrix is not None:
        if keys:
            raise ValueError("a rotation takes one example at a time")
        out = rotate(out.select(*AXES, "value"), matrix, shape, shape)
    return out


def edge_pad(vox: DataFrame, shape: tuple[int, int, int], pad: tuple[int, int, int], value: str = "value") -> DataFrame:
    """Repeat the border: each padded coordinate reads the clamped one."""
    out = vox
    for a, n, p in zip(AXES, shape, pad):
        reps = F.when((F.col(a) == 0) & (F.col(a) == n - 1), F.sequence(F.lit(-p), F.lit(n - 1 + p))).when(F.col(a) == 0, F.sequence(F.lit(-p), F.lit(0))).when(F.col(a) == n - 1, F.sequence(F.lit(n - 1), F.lit(n - 1 + p))).otherwise(F.array(F.col(a).cast("int")))
        out = out.withColumn(a, F.explode(reps))
    return out
