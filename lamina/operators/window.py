"""Window operators over voxels: box sums, partition maps, face maxima, neighbourhood vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.sources.volume import with_halo

AXES = ("z", "y", "x")
#: Edge lengths (z, y, x) of the blocks that neighbourhoods are found in.
BLOCK = (64, 64, 64)


def box_sum(vox: DataFrame, value: str, radius: tuple[int, int, int], name: str = "box", keys: tuple[str, ...] = (), block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """Sum over the box of +-radius of each voxel; near the border only what exists. keys: only voxels of the same keys count.

    Each voxel is dealt once to its block and to those whose halo it is in; there, three-dimensional prefix sums give every box by its corners.
    """
    whole = isinstance(vox.schema[value].dataType, (T.IntegralType, T.BooleanType))
    names = vox.columns
    src = vox.withColumn("_v", F.coalesce(F.col(value).cast("long" if whole else "double"), F.lit(0)))

    def run(rows: pa.Table) -> pa.Table:
        at = [rows[a].to_numpy().astype(np.int64) for a in AXES]
        low = [c.min() for c in at]
        at = [c - o for c, o in zip(at, low)]
        shape = [int(c.max()) + 1 for c in at]
        dense = np.zeros([n + 1 for n in shape], np.int64 if whole else float)
        np.add.at(dense, tuple(c + 1 for c in at), rows["_v"].to_numpy())
        for axis in range(3):
            np.cumsum(dense, axis, out=dense)
        core = np.flatnonzero(rows["is_core"].to_numpy(zero_copy_only=False))
        first = [np.maximum(c[core] - r, 0) for c, r in zip(at, radius)]
        last = [np.minimum(c[core] + r + 1, n) for c, r, n in zip(at, radius, shape)]
        total = np.zeros(len(core), dense.dtype)
        for corner in np.ndindex(2, 2, 2):
            total += (-1) ** (3 - sum(corner)) * dense[tuple(last[k] if c else first[k] for k, c in enumerate(corner))]
        return rows.select(names).take(pa.array(core)).append_column(name, pa.array(total.astype(np.int64)))

    schema = T.StructType([*vox.schema.fields, T.StructField(name, T.LongType())])
    return with_halo(src, block, radius).groupBy(*keys, "bz", "by", "bx").applyInArrow(run, schema)


def interior(vox: DataFrame, shape: tuple[int, int, int], radius: tuple[int, int, int]) -> DataFrame:
    out = vox
    for a, n, r in zip(AXES, shape, radius):
        out = out.where(F.col(a).between(r, n - r - 1))
    return out


def partition_map(vox: DataFrame, thresholds: list[float], radius: tuple[int, int, int], shape: tuple[int, int, int], excluded: str | None = None, block: tuple[int, int, int] = BLOCK, whitelist: DataFrame | None = None) -> DataFrame:
    """1 + number of thresholds that the share of equal labels in the box reaches; 0 unlabelled (or not in the whitelist, a table of labels), 255 excluded.

    Only labelled voxels enter the boxes, keyed by label, so there is no label-by-voxel cross join.
    """
    own = vox.where("label > 0")
    if whitelist is not None:
        own = own.join(whitelist.select("label").distinct(), "label", "left_semi")
    labelled = box_sum(own.withColumn("_one", F.lit(1)), "_one", radius, "same", ("label",), block)
    n = 1
    for r in radius:
        n *= 2 * r + 1
    bucket = sum([(F.col("same") / F.lit(float(n)) >= t).cast("int") for t in thresholds], F.lit(1))
    marked = labelled.select(*AXES, bucket.cast("int").alias("_p"))
    out = interior(vox, shape, radius).join(marked, list(AXES), "left")
    part = F.coalesce("_p", F.lit(0))
    if excluded:
        part = F.when(F.col(excluded), 255).otherwise(part)
    return out.withColumn("partition", part.cast("int")).drop("_p")


def pairs_at(vox: DataFrame, offsets: list[tuple[int, int, int]], block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """(z, y, x, label, offset_no, other): each voxel of (z, y, x, label) with the label of the voxel at each offset, where that one exists.

    Found by shifted views of blocks that hold as much more as the offsets reach, so voxels are dealt once, whatever the number of offsets.
    """
    reach = tuple(max(abs(o[k]) for o in offsets) for k in range(3))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at = [rows[a].to_numpy(np.int64) for a in AXES]
        low = [c.min() - r for c, r in zip(at, reach)]
        at = [c - o for c, o in zip(at, low)]
        shape = tuple(int(c.max()) + r + 1 for c, r in zip(at, reach))
        label, there = np.zeros(shape, np.int64), np.zeros(shape, bool)
        label[tuple(at)], there[tuple(at)] = rows["label"], True
        at = [c[rows["is_core"].to_numpy()] for c in at]
        out = []
        for k, o in enumerate(offsets):
            to = tuple(c + d for c, d in zip(at, o))
            on = there[to]
            own, to = tuple(c[on] for c in at), tuple(c[on] for c in to)
            out.append(pd.DataFrame({**{a: (c + m).astype(np.int32) for a, c, m in zip(AXES, own, low)}, "label": label[own], "offset_no": np.int32(k), "other": label[to]}))
        return pd.concat(out)

    return with_halo(vox.select(*AXES, F.col("label").cast("long").alias("label")), block, reach).groupBy("bz", "by", "bx").applyInPandas(run, "z int, y int, x int, label long, offset_no int, other long")


def redundant_affinities(vox: DataFrame, radius: tuple[int, int, int], block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """(z, y, x, dz, dy, dx, same): equal nonzero label at each offset of the window, where both voxels exist."""
    offs = [tuple(c - r for c, r in zip(o, radius)) for o in np.ndindex(*[2 * r + 1 for r in radius])]
    of = F.element_at(F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for v, a in zip(o, AXES)]) for o in offs]), F.col("offset_no") + 1)
    same = (F.col("label") > 0) & (F.col("label") == F.col("other"))
    return pairs_at(vox, offs, block).withColumn("_o", of).select(*AXES, *[F.col(f"_o.d{a}").alias(f"d{a}") for a in AXES], same.alias("same"))


def face_maxima(logits: DataFrame, center: tuple[int, int, int], delta: tuple[int, int, int], threshold: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Largest logit on each face of the box at +-delta around the centre, if it reaches the threshold; ties: first in raster order. One row per face and position, duplicates removed."""
    faces = []
    inside = F.lit(True)
    for a, c, d in zip(AXES, center, delta):
        inside = inside & F.col(a).between(c - d, c + d)
    for a, c, d in zip(AXES, center, delta):
        if d:
            faces += [F.when(F.col(a) == c + s * d, F.lit(f"{a}{'+' if s > 0 else '-'}")) for s in (-1, 1)]
    rows = logits.where(inside).withColumn("face", F.explode(F.array_compact(F.array(*faces))))
    w = Window.partitionBy(*keys, "face").orderBy(F.desc("value"), *AXES)
    best = rows.where(~F.isnan("value")).withColumn("_r", F.row_number().over(w)).where((F.col("_r") == 1) & (F.col("value") >= threshold))
    off = [(F.col(a) - c).cast("int").alias(f"d{a}") for a, c in zip(AXES, center)]
    return best.select(*keys, F.col("value").alias("score"), *off).distinct()


def erode(vox: DataFrame, mask: str, times: int) -> DataFrame:
    """Binary erosion by the 6-neighbour cross; outside the volume and null neighbours count as false, a null voxel that nothing erodes stays null."""
    out = vox.withColumn("_m", F.col(mask).cast("int"))
    for _ in range(times):
        parts = []
        for a in AXES:
            w = Window.partitionBy(*[k for k in AXES if k != a]).orderBy(a)
            for fn in (F.lag, F.lead):
                at = fn(F.col(a)).over(w)
                near = F.abs(at - F.col(a)) == 1
                parts.append(F.coalesce(F.when(near, fn("_m").over(w)), F.lit(0)))
        out = out.withColumn("_n", F.when(F.least(*parts) == 0, 0).otherwise(F.col("_m"))).drop("_m").withColumnRenamed("_n", "_m")
    return out.withColumn("eroded", F.col("_m") == 1).drop("_m")
