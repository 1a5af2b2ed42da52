"""Scores of re-segmented pairs: both runs of a pair against each other and against the two original segments, and the rule that merges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators import kernels
from lamina.operators.patches import patches

AXES = ("z", "y", "x")
RUNS = ("a", "b")
SCORES = [
    "num_voxels_a long", "num_voxels_b long", "max_edt_a double", "max_edt_b double", "iou double",
    *[f"{r}_{c}" for r in RUNS for c in ("max_edt double", "num_voxels long", "deleted_voxels long", "segment_a_consistency double", "segment_b_consistency double")],
]
#: What a message row of a pair holds: a voxel's label, what the two runs say of a voxel, a move of a run.
LABEL, PROB, MOVE = 0, 1, 2


def _largest_distance(mask: np.ndarray, step: tuple[float, ...]) -> float | None:
    """Largest distance of the object's voxels to the outside within the box: 0 for no voxel, None where nothing is outside."""
    if mask.all():
        return None
    return float(kernels.distance(mask, step)[mask].max(initial=0.0))


def pair_evaluation(pairs: DataFrame, original: DataFrame, runs: DataFrame, moves: DataFrame, radius: tuple[int, int, int], voxel_size: tuple[float, float, float] = (1, 1, 1), threshold: float = 0.5) -> DataFrame:
    """One row for each of `pairs` (pair, id_a, id_b, z, y, x: its point) with a status and the scores of both runs, within +-radius of the point.

    original: (z, y, x, label). runs: (pair, run, z, y, x, prob), the object maps grown from a and from b, in coordinates of the
    volume; a voxel without a row, or with a null or NaN, was not visited. moves: (pair, run, z, y, x, deleted), each place a run
    looked from and the voxels that it took back there. voxel_size is in the order x, y, z.

    status is `incomplete` where the runs of a pair are not a and b, else `missing` where an original segment has no voxel in the
    box, else `ok`; scores are null unless it is `ok`. Of the originals and of both objects: voxels and the largest distance
    within (null if the object fills the box). Of both objects: the voxels taken back by moves in the box (its faces included), and the
    share of each original that it covers. iou is null where neither run has an object. Outside the volume nothing is labelled. Pairs with a
    null in their point or ids are `missing`, or `incomplete` without runs.

    Labels, maps and moves meet once, by pair; a task holds the box of one pair. Rows outside the boxes go before they are shuffled
    for that.
    """
    shape, step = tuple(2 * r + 1 for r in radius), voxel_size[::-1]
    point = pairs.select("pair", "id_a", "id_b", *[F.col(a).cast("int").alias(f"c{a}") for a in AXES])
    boxes = patches(point, original.where("label > 0").select(*AXES, F.col("label").cast("long").alias("label")), radius, ["label"])
    labels = point.join(boxes, ["cz", "cy", "cx"]).where("label = id_a OR label = id_b")
    place = lambda a, r: (F.col(a) - F.col(f"c{a}") + r).cast("int").alias(f"p{a}")

    def inside(rows: DataFrame, value: Column, kind: int) -> DataFrame:
        near = rows.join(point, "pair")
        for a, r in zip(AXES, radius):
            near = near.where(F.abs(F.col(a) - F.col(f"c{a}")) <= r)
        return near.select("pair", F.lit(kind).alias("kind"), "run", *[place(a, r) for a, r in zip(AXES, radius)], value.cast("double").alias("value"))

    side = F.when(F.col("label") == F.col("id_a"), "a").otherwise("b")
    both_sides = labels.where("id_a = id_b").withColumn("run", F.lit("b")).unionByName(labels.withColumn("run", side))
    messages = both_sides.select("pair", F.lit(LABEL).alias("kind"), "run", "pz", "py", "px", F.lit(1.0).alias("value"))
    prob = F.coalesce(F.nanvl("prob", F.lit(None)), F.lit(0.0))
    messages = messages.unionByName(inside(runs, prob, PROB).where(F.col("value") >= threshold)).unionByName(inside(moves, F.col("deleted"), MOVE))

    def score(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        masks = {(k, r): np.zeros(shape, bool) for k in (LABEL, PROB) for r in RUNS}
        for (kind, run), some in rows[rows["kind"] != MOVE].groupby(["kind", "run"]):
            masks[kind, run][tuple(some[f"p{a}"].to_numpy() for a in AXES)] = True
        out = {"pair": key[0]}
        for r in RUNS:
            out[f"num_voxels_{r}"], out[f"max_edt_{r}"] = int(masks[LABEL, r].sum()), _largest_distance(masks[LABEL, r], step)
        any_ = (masks[PROB, "a"] | masks[PROB, "b"]).sum()
        out["iou"] = (masks[PROB, "a"] & masks[PROB, "b"]).sum() / any_ if any_ else None
        taken = rows[rows["kind"] == MOVE].groupby("run")["value"].sum()
        for r in RUNS:
            got = masks[PROB, r]
            out |= {f"{r}_max_edt": _largest_distance(got, step), f"{r}_num_voxels": int(got.sum()), f"{r}_deleted_voxels": int(taken.get(r, 0))}
            for s in RUNS:
                own = masks[LABEL, s]
                out[f"{r}_segment_{s}_consistency"] = (got & own).sum() / own.sum() if own.any() else None
        return pd.DataFrame([out])

    schema = f"pair {dict(pairs.dtypes)['pair']}, " + ", ".join(SCORES)
    scores = messages.where("run IN ('a', 'b')").groupBy("pair").applyInPandas(score, schema)
    there = runs.groupBy("pair").agg(F.sort_array(F.collect_set("run")).alias("_runs"))
    out = pairs.select("pair", "id_a", "id_b", *AXES).join(there, "pair", "left").join(scores, "pair", "left")
    whole = F.coalesce(F.col("_runs") == F.array(*map(F.lit, RUNS)), F.lit(False))
    both = (F.coalesce("num_voxels_a", F.lit(0)) > 0) & (F.coalesce("num_voxels_b", F.lit(0)) > 0)
    out = out.withColumn("status", F.when(~whole, "incomplete").when(~both, "missing").otherwise("ok")).drop("_runs")
    names = [s.split()[0] for s in SCORES]
    return out.select("pair", "id_a", "id_b", *AXES, "status", *[F.when(F.col("status") == "ok", F.col(n)).alias(n) for n in names])


def accepts_merge(min_iou: float = 0.8, min_consistency: float = 0.6, max_deleted: float = 0.02) -> Column:
    """Whether a row of `pair_evaluation` is a merge: the runs agree, each covers both originals, and at least one of them took back little. False without scores."""
    shares = [F.col(f"{r}_segment_{s}_consistency") > min_consistency for r in RUNS for s in RUNS]
    calm = [F.coalesce(F.try_divide(f"{r}_deleted_voxels", f"{r}_num_voxels") < max_deleted, F.lit(False)) for r in RUNS]
    rule = (F.col("iou") > min_iou) & (calm[0] | calm[1])
    for s in shares:
        rule = rule & s
    return F.coalesce(rule, F.lit(False))
