"""Queries whose work is a kernel per block; where SQL can say it, a plain form is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import augment, kernels, labels, seeds, spatial, traverse
from lamina.plans.base import VOX, r9, vox
from lamina.plans.registry import query

S = SparkSession


@query(f"""WITH RECURSIVE {VOX}, n AS (SELECT z, y, x, label, (CAST(z AS BIGINT) << 42) | (CAST(y AS BIGINT) << 21) | x AS k FROM vox WHERE label > 0),
e AS (SELECT p.k AS u, q.k AS v FROM n p JOIN n q ON p.label = q.label AND ((q.z = p.z AND q.y = p.y AND abs(q.x - p.x) = 1) OR (q.z = p.z AND q.x = p.x AND abs(q.y - p.y) = 1) OR (q.y = p.y AND q.x = p.x AND abs(q.z - p.z) = 1))),
r(node, root) AS (SELECT k, k FROM n UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node)
SELECT z, y, x, label, min(root) AS component FROM r JOIN n ON n.k = r.node GROUP BY z, y, x, label""")
def connected_components(spark: S, d: str) -> DataFrame:
    return labels.split_components(vox(spark, d), (8, 8, 16))


@query(f"""WITH {VOX} SELECT p.z, p.y, p.x, round(sqrt(min((q.y - p.y) * (q.y - p.y) * 4.0 + (q.x - p.x) * (q.x - p.x))), 9) AS dist FROM vox p JOIN vox q ON q.z = p.z WHERE q.label = 0 GROUP BY p.z, p.y, p.x""")
def edt_block(spark: S, d: str) -> DataFrame:
    """Distance to the background within each slice, with voxels twice as high as wide."""
    import numpy as np
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((rows["y"].max() + 1, rows["x"].max() + 1), bool)
        a[rows["y"], rows["x"]] = rows["label"] > 0
        dist = kernels.distance(a, (2.0, 1.0))
        return pd.DataFrame({"z": rows["z"], "y": rows["y"], "x": rows["x"], "dist": dist[rows["y"], rows["x"]]})

    got = vox(spark, d).groupBy("z").applyInPandas(run, "z int, y int, x int, dist double")
    return got.select("z", "y", "x", r9(F.col("dist"), "dist"))


def _with_blocks(spark: S, d: str) -> DataFrame:
    v = vox(spark, d)
    return v.withColumns({"bz": F.floor(F.col("z") / 16), "bx": F.floor(F.col("x") / 32)})


SMALL = (8, 8, 16)  # tiles small enough that the test volumes have several along each axis


@query(None)
def seeds_peaks(spark: S, d: str) -> DataFrame:
    return seeds.peaks(vox(spark, d), sigma=2.0, tile=SMALL)


@query(None)
def seeds_peaks_2d(spark: S, d: str) -> DataFrame:
    return seeds.peaks_2d(vox(spark, d), min_distance=3, least=1.0, sigma=2.0, tile=SMALL)


def _local_maxima(name: str, r: str, where: str) -> str:
    """Voxels above 0 that no voxel of the box exceeds, nor equals it and comes before it."""
    return f"""{name} AS (SELECT p.z, p.y, p.x FROM vox p WHERE p.value > 0 AND NOT EXISTS (
  SELECT 1 FROM vox q WHERE {where} AND abs(q.y - p.y) <= {r} AND abs(q.x - p.x) <= {r} AND (q.value > p.value OR (q.value = p.value AND (q.z, q.y, q.x) < (p.z, p.y, p.x)))))"""


@query(None)
def seeds_fill_empty(spark: S, d: str) -> DataFrame:
    return seeds.fill_empty(vox(spark, d), tile=SMALL)


@query(f"""WITH {VOX}, {_local_maxima("a", "3", "abs(q.z - p.z) <= 3")}, {_local_maxima("b", "5", "q.z = p.z")}
SELECT CAST(row_number() OVER (ORDER BY k, z, y, x) AS BIGINT) AS ord, z, y, x FROM (SELECT 0 AS k, * FROM a UNION ALL SELECT 1, * FROM b)""")
def seeds_intensity_peaks(spark: S, d: str) -> DataFrame:
    """Brightest voxels of the box around them, then of the square in their slice."""
    return seeds.peaks_3d_2d(vox(spark, d), (), 3, 5, tile=SMALL)


THIN = "(z * 7 + y * 5 + x * 3) % 29 = 0"
EXPANDED = f"""{VOX}, s AS (SELECT z, y, x, label FROM vox WHERE label > 0 AND {THIN}),
o AS (SELECT CAST(a.i AS INTEGER) AS dz, CAST(b.i AS INTEGER) AS dy, CAST(c.i AS INTEGER) AS dx, a.i * a.i + b.i * b.i + c.i * c.i AS d2 FROM range(-2, 3) AS a(i), range(-2, 3) AS b(i), range(-2, 3) AS c(i)),
best AS (SELECT v.z, v.y, v.x, min(d2) AS d2 FROM (SELECT s.z + dz AS z, s.y + dy AS y, s.x + dx AS x, d2 FROM s, o WHERE d2 <= 4) n JOIN vox v ON v.z = n.z AND v.y = n.y AND v.x = n.x GROUP BY v.z, v.y, v.x)"""


@query(f"""WITH {EXPANDED} SELECT z, y, x, round(sqrt(d2), 9) AS dist FROM best""")
def expanded_distances(spark: S, d: str) -> DataFrame:
    """How far each voxel's nearest segment is, up to a distance of 2: whole volume, in blocks with a halo."""
    v = vox(spark, d).select(F.lit("v").alias("volume"), "z", "y", "x", F.when(F.expr(THIN), F.col("label")).otherwise(0).alias("label"))
    return spatial.expanded(v, (1, 1, 1), 2.0, (8, 8, 16)).where("nearest > 0").select("z", "y", "x", r9(F.col("dist"), "dist"))


WHOLE = f"""{VOX}, s AS (SELECT z, y, x, label FROM vox WHERE label > 0 AND {THIN}),
near AS (SELECT v.z, v.y, v.x, min(((v.z - s.z) * (v.z - s.z) * 4 + (v.y - s.y) * (v.y - s.y) + (v.x - s.x) * (v.x - s.x)) * 1000 + s.label) AS k FROM vox v, s GROUP BY v.z, v.y, v.x),
whole AS (SELECT z, y, x, CAST(k % 1000 AS BIGINT) AS nearest, sqrt(k // 1000) AS dist FROM near)"""


def _thin(spark: S, d: str) -> DataFrame:
    return vox(spark, d).select(F.lit("v").alias("volume"), "z", "y", "x", F.when(F.expr(THIN), F.col("label")).otherwise(0).alias("label"))


@query(f"WITH {WHOLE} SELECT z, y, x, nearest, round(dist, 9) AS dist FROM whole")
def nearest_segments(spark: S, d: str) -> DataFrame:
    """The nearest segment of every voxel, however far, with voxels twice as high as wide: the whole volume in small tiles."""
    got = spatial.nearest_in_volume(_thin(spark, d), (1, 1, 2), (8, 8, 16))
    return got.select("z", "y", "x", "nearest", r9(F.col("dist"), "dist"))


@query(f"""WITH {WHOLE}, o AS (SELECT * FROM (VALUES (0, 0, 0, 1), (1, 0, 1, 0), (2, 0, 1, 1), (3, 1, 0, 0), (4, 1, 0, 1), (5, 1, 1, 0), (6, 1, 1, 1)) AS o(k, dz, dy, dx)),
c AS (SELECT least(a.nearest, b.nearest) AS id_a, greatest(a.nearest, b.nearest) AS id_b, (a.dist + b.dist) / 2 AS dist, a.z, a.y, a.x, k
      FROM whole a, o JOIN whole b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.nearest <> b.nearest),
m AS (SELECT * FROM c QUALIFY dist = min(dist) OVER (PARTITION BY id_a, id_b)),
g AS (SELECT *, round(pow(z - avg(z) OVER p, 2) + pow(y - avg(y) OVER p, 2) + pow(x - avg(x) OVER p, 2), 9) AS d2 FROM m WINDOW p AS (PARTITION BY id_a, id_b))
SELECT id_a, id_b, round(dist, 9) AS dist, x, y, z FROM g QUALIFY row_number() OVER (PARTITION BY id_a, id_b ORDER BY d2, k, z, y, x) = 1""")
def decision_points_whole(spark: S, d: str) -> DataFrame:
    """Decision points after every voxel took its nearest segment, however far."""
    got = spatial.decision_points(spatial.expanded_candidates(_thin(spark, d), (1, 1, 2), None, (8, 8, 16)))
    return got.select("id_a", "id_b", r9(F.col("dist"), "dist"), "x", "y", "z")


@query(None)
def decision_points_expanded(spark: S, d: str) -> DataFrame:
    """Decision points after every voxel took its nearest segment, in the whole volume."""
    v = vox(spark, d).select(F.lit("v").alias("volume"), "z", "y", "x", "label")
    return spatial.decision_points(spatial.expanded_candidates(v, (1, 1, 1), 4.0, (16, 16, 16))).drop("volume")


CONFIG = traverse.Config(fov=(3, 3, 3), deltas=(1, 1, 1), min_size=3, boundary=(1, 1, 1))


@query(None)
def segment_all_standin(spark: S, d: str) -> DataFrame:
    return traverse.segment(_with_blocks(spark, d).select("bz", "bx", "z", "y", "x", "value"), ["bz", "bx"], traverse.threshold_predictor(0.1, 20.0), CONFIG, 0.2)


@query(None)
def segment_all_results(spark: S, d: str) -> DataFrame:
    """Voxels, origins, overlaps and counters of a run that begins with an existing segmentation and keeps off a mask."""
    v = _with_blocks(spark, d).select("bz", "bx", "z", "y", "x", "value", F.when((F.col("label") == 3) & (F.col("y") < 4), 3).otherwise(0).alias("start_label"), (F.col("x") % 16 == 7).alias("mask"))
    return traverse.segment_results(v, ["bz", "bx"], traverse.threshold_predictor(0.1, 20.0), CONFIG, 0.2)


@query(None)
def training_steps(spark: S, d: str) -> DataFrame:
    """Training examples of all sub-volumes: moves as inference makes them, through a seed that predictions change."""
    v = _with_blocks(spark, d).select("bz", "bx", "z", "y", "x", "value", F.when(F.col("label") > 0, 0.95).otherwise(0.05).alias("target"))
    go = traverse.steps_of_maxima((1, 1, 1), (3, 3, 3), (2, 4, 6))
    return traverse.training_steps(v, ["bz", "bx"], go, traverse.threshold_predictor(0.0, 20.0), CONFIG)


@query(None)
def resegment_points(spark: S, d: str) -> DataFrame:
    v = vox(spark, d)
    points = spatial.decision_points(spatial.contacts(v).withColumn("dist", F.lit(1.0)))
    return traverse.resegment(v.select("z", "y", "x", "value", "label"), points, (2, 4, 6), traverse.threshold_predictor(0.05, 20.0), CONFIG)


@query(None)
def warp_sections(spark: S, d: str) -> DataFrame:
    """Elastic, affine and blurred slices one after another."""
    v = vox(spark, d).select("z", "y", "x", "value")
    for kind, strength in (("elastic", 1.5), ("affine", 0.05), ("focus", 1.0)):
        v = augment.warp_slices(v, kind, 4, strength)
    return v
