"""Contrast-limited equalisation of slices by tables of clipped histograms, and histogram matching after it.

Each slice (a value of z) is cut into tiles. A tile's histogram is clipped, what was cut off is spread over all bins, and its running
share maps a bin to a brightness. A voxel's brightness is blended from the maps of the four tiles whose centres are around it. The
tables have `tiles` x `tiles` x `bins` rows a slice, whatever its size; voxels meet them once, by tile and bin, and are never held by slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 255  # brightness of a byte
EPSILON = 1e-9  # keeps shares that are whole levels but for rounding on their level


def _tile(at: Column, size: Column, parts: Column) -> Column:
    """The part that a place lies in; part i begins at floor(i * size / parts)."""
    return F.floor(((at + 1) * parts - 1) / size).cast("int")


def _centre(part: Column, size: Column, parts: Column) -> Column:
    return (F.floor(part * size / parts) + F.floor((part + 1) * size / parts) - 1) / 2


def equalised(vox: DataFrame, value: str = "value", tiles: int = 8, limit: float = 0.01, bins: int = 256, name: str = "equalised") -> DataFrame:
    """The rows with `name`, from 0 to 1: the contrast-limited equalisation of their slice, 0 throughout for a slice of one value only.

    A slice's extent and range are those of its voxels; limit is the largest share of a tile's voxels that a bin keeps (at least one voxel).
    Null and NaN values give null and count nowhere. Columns that begin with an underscore and are named below are taken.
    """
    v = F.col("_v")
    rows = vox.withColumn("_v", F.nanvl(F.col(value).cast("double"), F.lit(None)))
    slices = rows.where("_v IS NOT NULL").groupBy("z").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), *[f(a).alias(f"_{n}{a}") for a in "yx" for n, f in (("f", F.min), ("t", F.max))])
    slices = slices.select("z", "_low", "_high", *[c for a in "yx" for c in (F.col(f"_f{a}"), (F.col(f"_t{a}") - F.col(f"_f{a}") + 1).alias(f"_n{a}"))])
    slices = slices.withColumns({f"_k{a}": F.least(F.lit(tiles), F.col(f"_n{a}")) for a in "yx"})
    rows = rows.join(slices, "z", "left")
    share = (v - F.col("_low")) / (F.col("_high") - F.col("_low"))
    rows = rows.withColumn("_q", F.when(v.isNotNull() & (F.col("_high") > F.col("_low")), F.least(F.floor(share * bins), F.lit(bins - 1))).cast("int"))
    for a in "yx":
        at, size, parts = F.col(a) - F.col(f"_f{a}"), F.col(f"_n{a}"), F.col(f"_k{a}")
        part = _tile(at, size, parts)
        before = F.when(at < _centre(part, size, parts), part - 1).otherwise(part)
        rows = rows.withColumns({f"_p{a}": part, f"_i{a}": F.greatest(F.least(before, parts - 2), F.lit(0)).cast("int")})
        here = _centre(F.col(f"_i{a}"), size, parts)
        step = _centre(F.col(f"_i{a}") + 1, size, parts) - here
        rows = rows.withColumn(f"_w{a}", F.when(parts == 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - here) / step))))
    counts = rows.where("_q IS NOT NULL").groupBy("z", "_py", "_px", "_q").agg(F.count("*").alias("_n"))
    tile = Window.partitionBy("z", "_py", "_px")
    counts = counts.withColumn("_all", F.sum("_n").over(tile))
    most = F.greatest(F.lit(1.0), limit * F.col("_all"))
    counts = counts.withColumns({"_kept": F.least(F.col("_n").cast("double"), most), "_over": F.sum(F.greatest(F.col("_n") - most, F.lit(0.0))).over(tile)})
    every = counts.groupBy("z", "_py", "_px").agg(F.first("_all").alias("_all"), F.first("_over").alias("_over")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    kept = F.sum(F.coalesce("_kept", F.lit(0.0))).over(tile.orderBy("_q"))
    maps = every.join(counts.select("z", "_py", "_px", "_q", "_kept"), ["z", "_py", "_px", "_q"], "left")
    maps = maps.select("z", "_py", "_px", "_q", ((kept + F.col("_over") * (F.col("_q") + 1) / bins) / F.col("_all")).alias("_m00"))
    # a tile without voxels has no map; the blend leaves it out
    right = lambda c: F.lead(c).over(Window.partitionBy("z", "_py", "_q").orderBy("_px"))
    grid = slices.where("_high > _low").select("z", F.explode(F.sequence(F.lit(0), F.col("_ky").cast("int") - 1)).alias("_py"), "_kx")
    grid = grid.select("z", "_py", F.explode(F.sequence(F.lit(0), F.col("_kx").cast("int") - 1)).alias("_px")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    maps = grid.join(maps, ["z", "_py", "_px", "_q"], "left").withColumn("_m01", right("_m00"))
    below = lambda c: F.lead(c).over(Window.partitionBy("z", "_px", "_q").orderBy("_py"))
    maps = maps.withColumns({"_m10": below("_m00"), "_m11": below("_m01")}).withColumnsRenamed({"_py": "_iy", "_px": "_ix"})
    out = rows.join(maps, ["z", "_iy", "_ix", "_q"], "left")
    wy, wx = F.col("_wy"), F.col("_wx")
    weights = {"_m00": (1 - wy) * (1 - wx), "_m01": (1 - wy) * wx, "_m10": wy * (1 - wx), "_m11": wy * wx}
    total = lambda f: sum((f(F.col(m), w) for m, w in weights.items()), F.lit(0.0))
    blend = F.try_divide(total(lambda m, w: F.coalesce(m * w, F.lit(0.0))), total(lambda m, w: F.when(m.isNotNull(), w).otherwise(0.0)))
    return out.select(*[F.col(c) for c in vox.columns], F.when(F.col("_high") == F.col("_low"), F.when(v.isNotNull(), 0.0)).otherwise(blend).alias(name))


def matched(vox: DataFrame, lut: DataFrame, value: str = "value", masked: str | None = None, tiles: int = 8, limit: float = 0.01, bins: int = 256, name: str = "matched") -> DataFrame:
    """The rows with `name`: their value mapped through a table (i, v) of 255 steps by their cumulative share in their equalised slice.

    Shares count only voxels for which the column `masked` is not true; darker ones than all of these take the share of the darkest.
    A slice that is masked whole keeps its values, as do voxels without a value. The distribution of a slice has at most 256 levels, and
    meets the table before it meets the voxels.
    """
    rows = equalised(vox, value, tiles, limit, bins, "_eq").withColumn("_level", F.floor(F.col("_eq") * LEVELS + EPSILON).cast("int"))
    counted = F.lit(1) if masked is None else F.when(F.coalesce(F.col(masked), F.lit(False)), 0).otherwise(1)
    counts = rows.where("_level IS NOT NULL").groupBy("z", "_level").agg(F.sum(counted).alias("_n"))
    one, upto = Window.partitionBy("z"), Window.partitionBy("z").orderBy("_level")
    counts = counts.withColumns({"_all": F.sum("_n").over(one), "_cum": F.sum("_n").over(upto)})
    least = F.min(F.when(F.col("_cum") > 0, F.col("_cum"))).over(one)
    counts = counts.where("_all > 0" if masked else F.lit(True)).withColumn("i", F.floor(F.greatest("_cum", least) * LEVELS / F.col("_all")).cast("int"))
    levels = counts.join(lut.select("i", F.col("v").alias("_to")), "i").select("z", "_level", "_to")
    out = rows.join(levels, ["z", "_level"], "left")
    return out.select(*[F.col(c) for c in vox.columns], F.coalesce("_to", value).alias(name))
