"""Saved segmentations: sub-volumes by corner in one table per kind, with their origins; read by preference and made ready for use."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
#: Kinds of a saved segmentation, in the order of preference; checkpoints are only read if they are allowed.
KINDS = ("final", "legacy", "checkpoint")


def save_segmentation(vox: DataFrame, root: str, kind: str = "final", offset: tuple[int, int, int] = (0, 0, 0), prob: str | None = None) -> None:
    """Write (cz, cy, cx, z, y, x, label): marks below 0 become 0, an alignment's offset is taken back, a probability column may go along.

    Only the corners that are written are replaced.
    """
    if kind not in KINDS:
        raise ValueError(f"kinds are {', '.join(KINDS)}")
    corner = [f"c{a}" for a in AXES]
    cols = [*corner, *[(F.col(a) - o).cast("int").alias(a) for a, o in zip(AXES, offset)], F.greatest("label", F.lit(0)).cast("long").alias("label"), *([F.col(prob).cast("int").alias("prob")] if prob else [])]
    vox.select(*cols).repartition(*corner).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*corner).parquet(f"{root}/{kind}")


def save_raw(vox: DataFrame, root: str) -> None:
    """The aligned image of each corner beside its segmentation."""
    corner = [f"c{a}" for a in AXES]
    vox.select(*corner, *AXES, "value").repartition(*corner).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*corner).parquet(f"{root}/raw")


def save_origins(origins: DataFrame, root: str) -> None:
    """(cz, cy, cx, segment_id, z, y, x, iters) of the corners that are written."""
    corner = [f"c{a}" for a in AXES]
    origins.repartition(*corner).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*corner).parquet(f"{root}/origins")


def load_origins(spark: SparkSession, root: str, corner: tuple[int, int, int] | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{root}/origins")
    return rows if corner is None else rows.where(" AND ".join(f"c{a} = {c}" for a, c in zip(AXES, corner))).drop("cz", "cy", "cx")


def _found(spark: SparkSession, root: str, kinds: tuple[str, ...]) -> DataFrame:
    out = None
    for k, kind in enumerate(kinds):
        try:
            rows = spark.read.parquet(f"{root}/{kind}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            continue
        rows = rows.withColumns({"kind": F.lit(kind), "_order": F.lit(k)})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no segmentation below {root}")
    return out


def existing(spark: SparkSession, root: str, allow_checkpoint: bool = False) -> DataFrame:
    """(cz, cy, cx, kind): the corners that are there, each with the kind that would be read."""
    found = _found(spark, root, KINDS if allow_checkpoint else KINDS[:2])
    return found.groupBy("cz", "cy", "cx").agg(F.min_by("kind", "_order").alias("kind"))


@dataclass(frozen=True)
class SegmentationSource:
    """Where a segmentation is and how it is made ready; what is None is not asked for."""

    root: str
    allow_checkpoint: bool | None = None
    threshold: float | None = None
    split: bool | None = None
    min_size: int | None = None
    mask: str | None = None


def load_from_source(spark: SparkSession, source: SegmentationSource, corner: tuple[int, int, int] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """`load_segmentation` with the fields that are set."""
    given = {f.name: getattr(source, f.name) for f in fields(source) if getattr(source, f.name) is not None}
    return load_segmentation(spark, given.pop("root"), corner, **given)


def load_segmentation(
    spark: SparkSession, root: str, corner: tuple[int, int, int] | None = None, allow_checkpoint: bool = False, threshold: float | None = None, split: bool = False, min_size: int = 0, mask: str | None = None, block: tuple[int, int, int] = (64, 64, 64)
) -> tuple[DataFrame, DataFrame | None]:
    """(voxels, ids): of each corner the most preferred kind; voxels below a probability (a share of 255) or under a mask expression go; parts are split; small ones go.

    With split or min_size labels are new: ids maps new_id to old_id, for the origins of what is left. Split parts are
    found over all corners that are read: give one corner for ids of its own.
    """
    from lamina.operators import labels
    from lamina.operators.masks import coordinate_expression

    rows = _found(spark, root, KINDS if allow_checkpoint else KINDS[:2])
    if corner is not None:
        rows = rows.where(" AND ".join(f"c{a} = {c}" for a, c in zip(AXES, corner)))
    best = F.min("_order").over(Window.partitionBy("cz", "cy", "cx"))
    rows = rows.withColumn("_best", best).where("_order = _best").drop("_order", "_best", "kind")
    label = F.col("label")
    if threshold is not None:
        if "prob" not in rows.columns:
            raise ValueError("a threshold needs a segmentation that was saved with its probabilities")
        label = F.when((F.col("prob") > 0) & ((F.col("prob") - 0.5) / 255 < threshold), 0).otherwise(label)  # 0: never predicted
    if mask is not None:
        label = F.when(coordinate_expression(mask), 0).otherwise(label)
    rows = rows.withColumn("label", label.cast("long"))
    if split:
        return labels.cleaned(rows, block, max(min_size, 1))
    if min_size:
        size = rows.where("label > 0").groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
        ids = labels.number(size, "new_id", "label").select("new_id", F.col("label").alias("old_id"), "n")
        return rows.join(ids.select(F.col("old_id").alias("label"), "new_id"), "label").select(*AXES, F.col("new_id").alias("label")), ids
    return rows, None


def pick(df: DataFrame, names: list[str], name: str | None = None) -> DataFrame:
    """The first of the preferred columns that is there, under a common name; its own values, nulls included."""
    for n in names:
        if n in df.columns:
            return df.select(*[c for c in df.columns if c not in names], F.col(n).alias(name or names[0]))
    raise KeyError(f"none of {', '.join(names)} in {', '.join(df.columns)}")


def cut(vox: DataFrame, start: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """A box of a volume, with coordinates from its corner; the bounds reach the scan."""
    out = vox
    for a, s, n in zip(AXES, start, size):
        out = out.where(f"{a} >= {s} AND {a} < {s + n}")
    return out.withColumns({a: (F.col(a) - s).cast("int") for a, s in zip(AXES, start)})


def read_png_stack(spark: SparkSession, path: str) -> DataFrame:
    """(z, y, x, value) of a folder of images of one size: z counts them by name, the first channel counts."""
    import numpy as np
    import pandas as pd

    from lamina.operators.shared import number

    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    order = number(images.select("origin"), "_z", "origin")

    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)[:, :, -1]
                y, x = np.indices(a.shape)
                yield pd.DataFrame({"z": np.int32(r.z), "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "value": a.ravel().astype(float)})

    rows = images.join(order, "origin").select((F.col("_z") - 1).cast("int").alias("z"), "height", "width", "nChannels", "data")
    return rows.mapInPandas(run, "z int, y int, x int, value double")
