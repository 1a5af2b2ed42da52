"""Box arithmetic on columns: boxes are sz, sy, sx (inclusive) and ez, ey, ex (exclusive)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
Vector = tuple[Column | int, Column | int, Column | int]


def _columns(v: Vector) -> list[Column]:
    return [c if isinstance(c, Column) else F.lit(c).cast("long") for c in v]


def box(df: DataFrame, start: Vector | None = None, size: Vector | None = None, end: Vector | None = None) -> DataFrame:
    """Bounds from exactly two of start, size and end."""
    if sum(v is not None for v in (start, size, end)) != 2:
        raise ValueError("exactly two of start, size and end")
    s, n, e = (v and _columns(v) for v in (start, size, end))
    low = s or [b - a for a, b in zip(n, e)]
    high = e or [a + b for a, b in zip(s, n)]
    # all at once: the given columns may be bounds themselves
    return df.withColumns({f"s{a}": c for a, c in zip(AXES, low)} | {f"e{a}": c for a, c in zip(AXES, high)})


def _bounds(df: DataFrame, side: str) -> list[Column]:
    return [df[f"{side}{a}"] for a in AXES]


def adjusted(df: DataFrame, start: Vector = (0, 0, 0), end: Vector = (0, 0, 0)) -> DataFrame:
    """Offsets added to the bounds."""
    return box(df, start=tuple(a + b for a, b in zip(_bounds(df, "s"), _columns(start))), end=tuple(a + b for a, b in zip(_bounds(df, "e"), _columns(end))))


def translated(df: DataFrame, by: Vector) -> DataFrame:
    return adjusted(df, by, by)


def sub(df: DataFrame, start: Vector | None = None, end: Vector | None = None, size: Vector | None = None) -> DataFrame:
    """A box relative to the old start: what is not given keeps its bound; size goes with start or end, not with both or alone."""
    if size is not None and (start is None) == (end is None):
        raise ValueError("size goes with one of start and end")
    low, high = _bounds(df, "s"), _bounds(df, "e")
    s = start and [a + b for a, b in zip(low, _columns(start))]
    e = end and [a + b for a, b in zip(low, _columns(end))]
    if size is not None:
        return box(df, start=s and tuple(s), end=e and tuple(e), size=size)
    return box(df, start=tuple(s or low), end=tuple(e or high))


def align_and_crop(vox: DataFrame, source: tuple[int, int, int], target: tuple[int, int, int], size: tuple[int, int, int], value: str, fill: float | int = 0) -> DataFrame:
    """A sub-volume whose corner is `source`, read in the frame of another one (corner `target`, of the given size); `fill` where the source has nothing.

    Coordinates come and go relative to their own corner.
    """
    spark = vox.sparkSession
    nz, ny, nx = size
    i = F.col("id")
    grid = spark.range(nz * ny * nx).select(F.floor(i / (ny * nx)).cast("int").alias("z"), F.pmod(F.floor(i / nx), F.lit(ny)).cast("int").alias("y"), F.pmod(i, F.lit(nx)).cast("int").alias("x"))
    moved = vox.select(*[(F.col(a) + s - t).cast("int").alias(a) for a, s, t in zip(AXES, source, target)], value)
    inside = moved.where(" AND ".join(f"{a} BETWEEN 0 AND {n - 1}" for a, n in zip(AXES, size)))
    return grid.join(inside, list(AXES), "left").withColumn(value, F.coalesce(value, F.lit(fill).cast(vox.schema[value].dataType)))
