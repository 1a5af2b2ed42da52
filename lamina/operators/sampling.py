"""Coordinate sampling: balanced classes, boxes by volume, weighted and interleaved mixes, seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.shared import number

AXES = ("z", "y", "x")
IGNORED = 255


def uniform(seed: int, *cols: str) -> Column:
    """A reproducible uniform draw per row, from a hash of its columns."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))).cast("double")


def balanced(coords: DataFrame, cls: str, target: int | None = None, order: list | None = None, seed: int = 1, salts: int = 64) -> DataFrame:
    """Each class repeated (or cut) cyclically to the target, or to the largest class; `copy` numbers the repeats.

    Rows are numbered within salted parts of a class, so that one class with most of the rows is no single task; under a given order they are numbered by ranges of it.
    """
    rows = coords.where(F.col(cls) != IGNORED)
    counts = rows.groupBy(cls).agg(F.count("*").alias("_n"))
    goal = F.lit(target).cast("long") if target else F.max("_n").over(Window.partitionBy())
    counts = counts.withColumn("_goal", goal)
    if order:
        # numbered over all classes, less the rows of the classes before
        before = counts.select(cls, (F.sum("_n").over(Window.orderBy(cls)) - F.col("_n")).alias("_before"))
        numbered = number(rows, "_rn", cls, *order).join(F.broadcast(before), cls).withColumn("_rn", F.col("_rn") - F.col("_before")).drop("_before")
    else:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit(seed), *AXES), F.lit(salts)))
        part = salted.groupBy(cls, "_salt").agg(F.count("*").alias("_m"))
        before = part.withColumn("_before", F.sum("_m").over(Window.partitionBy(cls).orderBy("_salt")) - F.col("_m")).drop("_m")
        own = F.row_number().over(Window.partitionBy(cls, "_salt").orderBy(F.xxhash64(F.lit(seed + 1), *AXES), *AXES))
        numbered = salted.withColumn("_own", own).join(F.broadcast(before), [cls, "_salt"]).withColumn("_rn", F.col("_own") + F.col("_before")).drop("_own", "_before", "_salt")
    joined = numbered.join(F.broadcast(counts), cls)
    times = F.floor((F.col("_goal") - F.col("_rn")) / F.col("_n"))
    out = joined.where("_rn <= _goal").withColumn("copy", F.explode(F.sequence(F.lit(0), times.cast("int"))))
    return out.drop("_rn", "_n", "_goal")


def shuffled(df: DataFrame, seed: int, *cols: str) -> DataFrame:
    return df.orderBy(uniform(seed, *cols), *cols)


def within_margin(vox: DataFrame, shape: tuple[int, int, int], margin: tuple[int, int, int]) -> DataFrame:
    """Drop a border; a margin of 0 drops nothing."""
    return reduce(lambda d, k: d.where(F.col(k[0]).between(k[2], k[1] - k[2] - 1)), zip(AXES, shape, margin), vox)


def points_in_boxes(boxes: DataFrame, n: int, seed: int) -> DataFrame:
    """n voxels drawn with replacement from the boxes, by volume. Draws meet boxes through the running volume, as ranges."""
    spark = boxes.sparkSession
    size = reduce(lambda a, b: a * b, [(F.col(f"e{a}") - F.col(f"s{a}")).cast("long") for a in AXES])
    cum = boxes.withColumn("_vol", size).withColumn("_end", F.sum("_vol").over(Window.orderBy("box_id")))
    total = cum.agg(F.max("_end")).first()[0] or 0
    draws = spark.range(n).select("id", F.floor(uniform(seed, "id") * total).alias("_at"))
    width = max(1, total // 256)
    c = cum.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("_end") - F.col("_vol")) / width), F.floor((F.col("_end") - 1) / width))))
    d = draws.withColumn("_cell", F.floor(F.col("_at") / width))
    got = d.join(c, "_cell").where((F.col("_at") >= F.col("_end") - F.col("_vol")) & (F.col("_at") < F.col("_end")))
    i = F.col("_at") - (F.col("_end") - F.col("_vol"))
    ny, nx = F.col("ey") - F.col("sy"), F.col("ex") - F.col("sx")
    return got.select("id", "box_id", (F.col("sz") + F.floor(i / (ny * nx))).cast("int").alias("z"), (F.col("sy") + F.pmod(F.floor(i / nx), ny)).cast("int").alias("y"), (F.col("sx") + F.pmod(i, nx)).cast("int").alias("x"))


def weighted_mix(sources: dict[str, tuple[DataFrame, float]], n: int, seed: int) -> DataFrame:
    """n rows: each draw picks a source by weight, and that source's next row, cyclically."""
    names = list(sources)
    total = sum(w for _, w in sources.values())
    spark = sources[names[0]][0].sparkSession
    u = uniform(seed, "id")
    pick, at = F.lit(names[-1]), 1.0
    for name in reversed(names[:-1]):
        at = sum(sources[m][1] for m in names[: names.index(name) + 1]) / total
        pick = F.when(u < at, name).otherwise(pick)
    draws = spark.range(n).withColumn("source", pick)
    parts = []
    for name, (df, _) in sources.items():
        size = max(df.count(), 1)
        rows = number(df.withColumn("_u", uniform(seed + 1, *df.columns)), "_k", "_u", *df.columns).drop("_u").withColumn("_k", F.col("_k") - 1)
        own = number(draws.where(F.col("source") == name), "_k", "id").withColumn("_k", (F.col("_k") - 1) % size)
        parts.append(own.join(rows, "_k").drop("_k"))
    return reduce(DataFrame.unionByName, parts)


def interleave(sources: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """Rows of all sources in turns."""
    parts = [number(df.withColumn("source", F.lit(n)), "turn", *order) for n, df in sources.items()]
    return reduce(DataFrame.unionByName, parts).orderBy("turn", "source")


def batches(df: DataFrame, size: int, order: list) -> DataFrame:
    return number(df, "_row", *order).withColumn("batch", F.floor((F.col("_row") - 1) / size).cast("long")).drop("_row")


def epoch(df: DataFrame, number_of: int, seed: int, *cols: str) -> DataFrame:
    """The rows in the order of one epoch: every epoch shuffles anew, and the same epoch always alike."""
    return shuffled(df, seed * 1_000_003 + number_of, *cols)
