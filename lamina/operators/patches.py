"""Patches of a volume around centres, and what is made of them: tests of their shell, training examples."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lamina.functions import scalar
from lamina.sources.volume import with_halo

AXES = ("z", "y", "x")
CENTRE = ("cz", "cy", "cx")
AT_ONCE = 1 << 19  # voxels of patches that a task hands on together


def patches(centres: DataFrame, vox: DataFrame, radius: tuple[int, int, int], columns: list[str], block: tuple[int, int, int] = (32, 32, 32)) -> DataFrame:
    """(cz, cy, cx, pz, py, px, *columns): the voxels within the radius of each centre, pz, py, px from 0 at the patch's corner.

    Voxels go to the blocks that need them, a centre to the block that it lies in; so a voxel is dealt once and to the halos, whatever
    the number of centres. Equal centres count once; centres with null in them have no patch; voxels that are not in the
    volume have no row. Columns hold numbers without nulls.
    """
    kinds = {f.name: f.dataType.simpleString() for f in vox.schema.fields}
    dealt = with_halo(vox.select(*AXES, *columns), block, radius).drop("is_core").withColumn("_centre", F.lit(False))
    own = [F.floor(F.col(c) / s).cast("int").alias(f"b{a}") for a, c, s in zip(AXES, CENTRE, block)]
    points = centres.select(*CENTRE).dropna().distinct()
    points = points.select(*[F.col(c).cast("int").alias(a) for a, c in zip(AXES, CENTRE)], *[F.lit(0).cast(kinds[c]).alias(c) for c in columns], *own, F.lit(True).alias("_centre"))
    schema = StructType.fromDDL(", ".join([*[f"{c} int" for c in (*CENTRE, "pz", "py", "px")], *[f"{c} {kinds[c]}" for c in columns]]))
    extent = [s + 2 * r for s, r in zip(block, radius)]
    offsets = np.indices([2 * r + 1 for r in radius]).reshape(3, -1)  # from the patch's corner

    def one(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        is_centre = rows["_centre"].to_numpy(bool)
        at = rows[list(AXES)].to_numpy(np.int64).T - np.array([[int(k) * s - r] for k, s, r in zip(key, block, radius)])
        where = np.full(extent, -1, np.int64)
        where[tuple(at[:, ~is_centre])] = np.flatnonzero(~is_centre)
        found = np.flatnonzero(is_centre)
        step = max(1, AT_ONCE // offsets.shape[1])
        for k in range(0, len(found), step):
            some = found[k : k + step]
            places = at[:, some, None] - np.array(radius)[:, None, None] + offsets[:, None, :]
            hit = where[tuple(places)]
            c, p = np.nonzero(hit >= 0)
            out = rows.loc[some[c], list(AXES)].set_axis(list(CENTRE), axis=1).reset_index(drop=True)
            out[["pz", "py", "px"]] = offsets[:, p].T.astype(np.int32)
            yield pd.concat([out, rows.loc[hit[c, p], columns].reset_index(drop=True)], axis=1)

    return dealt.unionByName(points).groupBy("bz", "by", "bx").applyInPandas(one, schema)


def shell_any(centres: DataFrame, vox: DataFrame, radius: tuple[int, int, int], condition: Column, columns: list[str], name: str = "move") -> DataFrame:
    """(cz, cy, cx, name): whether any voxel on the faces of the box around a centre meets the condition."""
    face = reduce(lambda a, b: a | b, [(F.col(f"p{a}") == 0) | (F.col(f"p{a}") == 2 * r) for a, r in zip(AXES, radius)])
    return patches(centres, vox, radius, columns).where(face).groupBy(*CENTRE).agg(F.bool_or(condition).alias(name))


def examples(centres: DataFrame, vox: DataFrame, radius: tuple[int, int, int], mean: float, stddev: float, flip: tuple[bool, bool, bool] = (False, False, False), softness: float = 0.05) -> DataFrame:
    """(cz, cy, cx, pz, py, px, image, target): patches of (value, label) as training examples.

    The image is normalised; the target is soft: near 1 on voxels with the centre's own label (not 0), near 0 elsewhere. A patch is
    reflected along the axes that flip names. A centre outside the volume has no label of its own.
    """
    p = patches(centres, vox, radius, ["value", "label"])
    middle = reduce(lambda a, b: a & b, [F.col(f"p{a}") == r for a, r in zip(AXES, radius)])
    own = p.where(middle).select(*CENTRE, F.col("label").alias("_own"))
    same = F.coalesce((F.col("label") > 0) & (F.col("label") == F.col("_own")), F.lit(False))
    place = [(F.lit(2 * r) - F.col(f"p{a}") if f else F.col(f"p{a}")).cast("int").alias(f"p{a}") for a, r, f in zip(AXES, radius, flip)]
    return p.join(own, list(CENTRE), "left").select(*CENTRE, *place, ((F.col("value") - mean) / stddev).alias("image"), scalar.soften(same, softness).alias("target"))
