"""Greedy spacing of points: the strongest stays, those within a box around it go, and so on. Independent of how the points are dealt.

Found as a fixed point: each block works through its points in order of strength, given which points of its halo stay, and works again
when one of those has changed. A point's state is right once those of the stronger points near it are, so what holds still is the greedy
choice itself, whatever was assumed at first (a block at first works through its halo as if nothing lay beyond it). A wrong assumption
reaches as far as it changes choices: rounds grow with that distance, not with the number of blocks in a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.shared import kept
from lamina.sources.volume import with_halo

AXES = ("z", "y", "x")


def _settle(rows: pd.DataFrame, reach: tuple[int, int, int]) -> list[bool]:
    """For each row, strongest first, whether it stays. Rows outside the core keep the state they have, if any."""
    at = rows[list(AXES)].to_numpy(np.int64)
    at = at - at.min(0)
    gone = np.zeros(at.max(0) + 1, bool)
    rz, ry, rx = reach
    given = ~rows["is_core"] & rows["stays"].notna()
    out = []
    for (z, y, x), held, was in zip(at.tolist(), given.tolist(), rows["stays"].tolist()):
        stays = was if held else not gone[z, y, x]
        if stays:
            gone[max(0, z - rz) : z + rz + 1, max(0, y - ry) : y + ry + 1, max(0, x - rx) : x + rx + 1] = True
        out.append(stays)
    return out


def spaced(points: DataFrame, reach: tuple[int, int, int], keys: tuple[str, ...] = (), block: tuple[int, int, int] = (64, 64, 64)) -> DataFrame:
    """The points (keys, z, y, x, value) that greedy spacing keeps: the largest value first, ties in raster order; none within +-reach of one kept before. keys tell volumes apart."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # of rows that are equal, the one that stayed comes first again
        rows = rows.sort_values(["value", *AXES, "stays"], ascending=[False, True, True, True, False], kind="stable")
        stays = np.array(_settle(rows, reach), bool)
        rows["changed"] = rows["stays"].isna() | (rows["stays"].eq(True) != stays)
        rows["stays"] = stays
        return rows.loc[rows["is_core"], [*keys, *AXES, "value", "stays", "changed"]]

    schema = ", ".join([*(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys), "z int, y int, x int, value double, stays boolean, changed boolean"])
    cell = [*keys, "bz", "by", "bx"]
    own = {f"b{a}": F.floor(F.col(a) / b).cast("int") for a, b in zip(AXES, block)}
    settled = lambda dealt: dealt.groupBy(*cell).applyInPandas(run, schema)
    first = points.select(*keys, *[F.col(a).cast("int").alias(a) for a in AXES], F.col("value").cast("double").alias("value"), F.lit(None).cast("boolean").alias("stays"))
    state, again = kept(settled(with_halo(first, block, reach)), "spaced").drop("changed"), None
    while True:
        dealt = with_halo(state, block, reach)
        if again is None:
            new = settled(dealt)
        else:
            rest = state.withColumns(own).join(again, cell, "left_anti").drop("bz", "by", "bx").withColumn("changed", F.lit(False))
            new = settled(dealt.join(again, cell, "left_semi")).unionByName(rest)
        new = kept(new, "spaced")
        # the blocks that see a changed point of another one
        again = with_halo(new.where("changed"), block, reach).where("NOT is_core").select(cell).distinct()
        if again.isEmpty():
            return new.where("stays").select(*keys, *AXES, "value")
        state = new.drop("changed")
