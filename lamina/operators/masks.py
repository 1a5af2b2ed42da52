"""Masks over voxels, and boxes: channels, expressions, dilation, bounds, tiling."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


@dataclass(frozen=True)
class Channel:
    """One channel's mask: values, or an inclusive range."""

    column: str
    values: tuple = ()
    low: float | None = None
    high: float | None = None
    invert: bool = False

    def column_of(self) -> Column:
        c = F.col(self.column)
        m = c.isin(*self.values) if self.values else (c >= self.low) & (c <= self.high)
        return ~m if self.invert else m


@dataclass(frozen=True)
class Mask:
    channels: tuple[Channel, ...] = field(default=())
    expression: str | None = None
    invert: bool = False

    def column_of(self) -> Column:
        parts = [c.column_of() for c in self.channels]
        if self.expression:
            parts.append(coordinate_expression(self.expression))
        m = reduce(lambda a, b: a | b, parts)
        return ~m if self.invert else m


def coordinate_expression(text: str) -> Column:
    """A boolean SQL expression over z, y and x; anything but coordinates, numbers and operators is refused."""
    for word in re.findall(r"[A-Za-z_]\w*", text):
        if word.lower() not in {"z", "y", "x", "and", "or", "not", "between", "abs", "mod", "true", "false"}:
            raise ValueError(f"not allowed in a mask expression: {word}")
    if re.search(r"[^\w\s+\-*/%<>=!().,]", text):
        raise ValueError("not allowed in a mask expression")
    # a number or a null is no mask: the plan refuses one, and a null masks nothing
    return F.coalesce(F.expr(f"if(({text}), true, false)"), F.lit(False))


def restricted(vox: DataFrame, keys: list[str], masks: list[Mask] = (), seed_masks: list[Mask] = ()) -> DataFrame:
    """Voxels with `mask` (no moves) and `seed_mask` (no seeds), without the sub-volumes in which no move or no seed is left: they need no canvas."""
    out = vox.withColumns({"mask": build_mask(list(masks)), "seed_mask": build_mask(list(seed_masks))})
    open_ = out.groupBy(*keys).agg(F.bool_and("mask").alias("_m"), F.bool_and("seed_mask").alias("_s")).where("NOT _m AND NOT _s").select(*keys)
    return out.join(open_, keys, "left_semi")


def excluded(segmented: Column, mask: Column, seed_mask: Column) -> Column:
    """Where no seed may start."""
    return segmented | mask | seed_mask


def build_mask(masks: list[Mask]) -> Column:
    return reduce(lambda a, b: a | b, [m.column_of() for m in masks], F.lit(False))


def dilate(vox: DataFrame, mask: str, radius: tuple[int, int, int]) -> DataFrame:
    """True where any masked voxel lies within the window."""
    from lamina.operators.window import box_sum

    out = box_sum(vox.withColumn("_m", F.col(mask).cast("long")), "_m", radius, "_near")
    return out.withColumn("dilated", F.col("_near") >= 1).drop("_m", "_near")


def in_boxes(points: DataFrame, boxes: DataFrame, cell: int = 64, radius: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Points whose window lies in any box of their volume, by cells that both sides share (no theta join)."""
    b = boxes
    for a in AXES:
        b = b.withColumn(f"_c{a}", F.explode(F.sequence(F.floor(F.col(f"s{a}") / cell), F.floor((F.col(f"e{a}") - 1) / cell))))
    p = points.withColumns({f"_c{a}": F.floor(F.col(a) / cell) for a in AXES})
    on = [p[f"_c{a}"] == b[f"_c{a}"] for a in AXES] + [p["volume"] == b["volume"]]
    for a, r in zip(AXES, radius):
        on += [b[f"s{a}"] <= p[a] - r, b[f"e{a}"] > p[a] + r]
    return p.join(b, on, "left_semi").drop(*[f"_c{a}" for a in AXES])


def in_boxes_or_unbounded(points: DataFrame, boxes: DataFrame, cell: int = 64) -> DataFrame:
    """Points in any box of their volume; volumes without boxes pass."""
    free = points.join(boxes.select("volume").distinct(), "volume", "left_anti").select(points.columns)
    return in_boxes(points, boxes, cell).select(points.columns).unionByName(free)


# ---------------------------------------------------------------- boxes


def box_end(start: Column, size: Column) -> Column:
    return start + size


def overlaps(a: DataFrame, b: DataFrame, cell: int = 32) -> DataFrame:
    """Pairs of boxes with a common part, and that part; each pair once although it may share several cells."""
    own, other = a, b
    for k in AXES:
        own = own.withColumn(f"_c{k}", F.explode(F.sequence(F.floor(F.col(f"s{k}") / cell), F.floor((F.col(f"e{k}") - 1) / cell))))
        other = other.withColumn(f"_c{k}", F.explode(F.sequence(F.floor(F.col(f"s{k}") / cell), F.floor((F.col(f"e{k}") - 1) / cell))))
    l, r = own.alias("l"), other.alias("r")
    on = [F.col(f"l._c{k}") == F.col(f"r._c{k}") for k in AXES]
    low = {k: F.greatest(f"l.s{k}", f"r.s{k}") for k in AXES}
    high = {k: F.least(f"l.e{k}", f"r.e{k}") for k in AXES}
    # a pair counts in the cell of its common part's first corner only
    once = reduce(lambda p, q: p & q, [(low[k] < high[k]) & (F.floor(low[k] / cell) == F.col(f"l._c{k}")) for k in AXES])
    cols = [F.col("l.box_id").alias("box_a"), F.col("r.box_id").alias("box_b")]
    return l.join(r, on).where(once).select(*cols, *[low[k].alias(f"s{k}") for k in AXES], *[high[k].alias(f"e{k}") for k in AXES])


def overlapping_pairs(boxes: DataFrame, cell: int = 32) -> DataFrame:
    """Each two of the boxes (different box_id) that have a common part once, the smaller id first, and that part.

    A pair meets where the common part begins. On the z axis that is the start of one of the two, which lies in one cell then; only the
    other is dealt to all of its cells there. Cells are as long as the boxes are on average, and no longer than `cell`.
    """
    full = boxes.where(" AND ".join(f"s{k} < e{k}" for k in AXES)).select("box_id", *[f"{e}{k}" for e in "se" for k in AXES])
    mean = full.agg(*[F.avg(F.col(f"e{k}") - F.col(f"s{k}")) for k in AXES]).first()
    size = {k: max(1, min(cell, round(m or 1))) for k, m in zip(AXES, mean)}
    place = lambda c, k: F.floor(c / size[k])
    over = lambda df, axes: reduce(lambda d, k: d.withColumn(f"_c{k}", F.explode(F.sequence(place(F.col(f"s{k}"), k), place(F.col(f"e{k}") - 1, k)))), axes, df)
    late, early = over(full.withColumn("_cz", place(F.col("sz"), "z")), AXES[1:]), over(full, AXES)
    # few bytes of boxes make many pairs: sizes on disk say neither how many tasks that takes nor whether a side can be broadcast
    n = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    late, early = (d.repartition(n, *[f"_c{k}" for k in AXES]).alias(a) for d, a in ((late, "l"), (early, "r")))
    low = {k: F.greatest(f"l.s{k}", f"r.s{k}") for k in AXES}
    high = {k: F.least(f"l.e{k}", f"r.e{k}") for k in AXES}
    on = [F.col(f"l._c{k}") == F.col(f"r._c{k}") for k in AXES]
    # of two that begin in the same slice, the one with the smaller id counts as the earlier
    on += [F.expr("r.sz <= l.sz AND (r.sz < l.sz OR r.box_id < l.box_id) AND r.box_id <> l.box_id"), *[low[k] < high[k] for k in AXES]]
    on += [place(low[k], k) == F.col(f"l._c{k}") for k in AXES[1:]]
    ids = [F.least("l.box_id", "r.box_id").alias("box_a"), F.greatest("l.box_id", "r.box_id").alias("box_b")]
    return late.join(early.hint("merge"), reduce(lambda p, q: p & q, on)).select(*ids, *[low[k].alias(f"s{k}") for k in AXES], *[high[k].alias(f"e{k}") for k in AXES])


def hull(boxes: DataFrame, *keys: str) -> DataFrame:
    aggs = [F.min(f"s{k}").alias(f"s{k}") for k in AXES] + [F.max(f"e{k}").alias(f"e{k}") for k in AXES]
    return boxes.groupBy(*keys).agg(*aggs)


def tiling(spark, start: tuple, size: tuple, tile: tuple, overlap: tuple, keep_small: bool = False, shift_back: bool = False) -> DataFrame:
    """Overlapping tiles of a box (all xyz), x fastest: stride is tile - overlap; tiles no larger than the overlap go unless kept; at the far edge they are clipped, or shifted back."""
    counts = []
    for n, t, o in zip(size, tile, overlap):
        k = -(-n // (t - o)) if keep_small else max(1, -(-(n - o) // (t - o)))
        counts.append(k)
    rows = spark.range(counts[0] * counts[1] * counts[2]).withColumnRenamed("id", "tile")
    ix = [F.pmod("tile", F.lit(counts[0])), F.pmod(F.floor(F.col("tile") / counts[0]), F.lit(counts[1])), F.floor(F.col("tile") / (counts[0] * counts[1]))]
    cols = [F.col("tile")]
    for a, i, s, n, t, o, c in zip("xyz", ix, start, size, tile, overlap, counts):
        at = i * (t - o) + s
        end = F.least(at + t, F.lit(s + n))
        if shift_back:
            at = F.greatest(F.least(at, F.lit(s + n - t)), F.lit(s))
        cols += [at.cast("long").alias(f"s{a}"), end.cast("long").alias(f"e{a}"), (i == 0).alias(f"first_{a}"), (i == c - 1).alias(f"last_{a}")]
    return rows.select(*cols)


def neighbour(tile: Column, counts: tuple[int, int, int], offset: tuple[int, int, int]) -> Column:
    """Number of the tile at an offset (xyz), null outside."""
    nx, ny, nz = counts
    x, y, z = F.pmod(tile, F.lit(nx)) + offset[0], F.pmod(F.floor(tile / nx), F.lit(ny)) + offset[1], F.floor(tile / (nx * ny)) + offset[2]
    inside = (x >= 0) & (x < nx) & (y >= 0) & (y < ny) & (z >= 0) & (z < nz)
    return F.when(inside, (z * ny + y) * nx + x).cast("long")


def shrink(boxes: DataFrame, radius: tuple[int, int, int]) -> DataFrame:
    out = boxes.withColumns({f"s{k}": F.col(f"s{k}") + r for k, r in zip(AXES, radius)} | {f"e{k}": F.col(f"e{k}") - r for k, r in zip(AXES, radius)})
    return out.where(" AND ".join(f"s{k} < e{k}" for k in AXES))


def crop_pad(vox: DataFrame, center: tuple[int, int, int], crop: tuple[int, int, int], target: tuple[int, int, int], value: str) -> DataFrame:
    """Values around a centre on a grid of the target size; zeros outside the crop (odd differences: less on the left)."""
    spark = vox.sparkSession
    n = target[0] * target[1] * target[2]
    grid = spark.range(n).select(*[c.alias(f"t{a}") for a, c in zip(AXES, (F.floor(F.col("id") / (target[1] * target[2])), F.pmod(F.floor(F.col("id") / target[2]), F.lit(target[1])), F.pmod("id", F.lit(target[2]))))])
    rows = vox
    for a, c, k in zip(AXES, center, crop):
        rows = rows.where(F.col(a).between(c - k // 2, c - k // 2 + k - 1))
    moved = rows.select(*[(F.col(a) - (c - k // 2) + (t - k) // 2).cast("long").alias(f"t{a}") for a, c, k, t in zip(AXES, center, crop, target)], value)
    return grid.join(moved, [f"t{a}" for a in AXES], "left").withColumn(value, F.coalesce(value, F.lit(0))).select(*[F.col(f"t{a}").cast("int").alias(a) for a in AXES], value)


def oob_weight(points: DataFrame, boxes: DataFrame, cell: int = 64) -> DataFrame:
    """1.0 for points inside any box, else 0.0."""
    inside = in_boxes(points, boxes, cell).select("volume", *AXES).distinct().withColumn("_in", F.lit(1.0))
    return points.join(inside, ["volume", *AXES], "left").withColumn("weight", F.coalesce("_in", F.lit(0.0))).drop("_in")


def ranked(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
